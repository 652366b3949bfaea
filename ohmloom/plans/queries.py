"""Registered queries of the time-series engine over the driver's tables, and their SQL for a second engine.

Events stand for sensor readings (event_type the sensor, user_id the entity), embeddings for a feature matrix whose label
gives the context and, where it is 0, the anomaly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, detect, evaluate, factor, features, select
from ..sources.io import cut
from . import feature_queries, injection_queries, registry, table_queries  # noqa: F401
from .registry import TALL_SQL as _TALL_SQL
from .registry import events as _events
from .registry import out as _out
from .registry import query as _query
from .registry import table as _table
from .registry import tall as _tall
from .registry import vectors as _vectors


@_query("select time_bucket(interval '15 minutes', ts) as window_id, event_type, round(avg(value), 6) as mean_value, max(value) as max_value from events group by all")
def resample_15min(spark, d):
    e = _events(spark, d).withColumn("m", F.col("value"))
    return _out(align.resample(e, ["value"], ["m"], by=["event_type"]).select("window_id", "event_type", F.round("value", 6).alias("mean_value"), F.col("m").alias("max_value")), "window_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_15min(spark, sf_dir)


@_query("""select user_id, event_type, count(*) as length, round(sum(value), 5) as sum_values, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_pop(value), 6) as standard_deviation,
round(var_pop(value), 3) as variance, round(sqrt(avg(value * value)), 6) as root_mean_square, max(value) as maximum, max(abs(value)) as absolute_maximum, min(value) as minimum from events group by all""")
def minimal_features(spark, d):
    f = features.minimal(_events(spark, d), ["user_id", "event_type"])
    digits = {"sum_values": 5, "variance": 3}
    rounded = [F.round(c, digits.get(c, 6)).alias(c) for c in ("sum_values", "mean", "median", "standard_deviation", "variance", "root_mean_square")]
    return f.select("user_id", "event_type", F.col("length").cast("long").alias("length"), *rounded, "maximum", "absolute_maximum", "minimum")


@_query("""with o as (select user_id, event_type, value, lag(value) over w as p, lag(value, 2) over w as p2, row_number() over w - 1 as i, avg(value) over g as m, var_pop(value) over g as v, count(*) over g as n from events window w as (partition by user_id, event_type order by ts), g as (partition by user_id, event_type))
select user_id, event_type, round(coalesce(avg(abs(value - p)), null), 6) as mean_abs_change, round(coalesce(sum(abs(value - p)), 0), 5) as absolute_sum_of_changes,
cast(count(*) filter (where value > m) as double) as count_above_mean, cast(count(*) filter (where value < m) as double) as count_below_mean, round(sum(value * value), 4) as abs_energy,
round(quantile_cont(value, 0.1), 6) as q10, round(quantile_cont(value, 0.9), 6) as q90, round(sqrt(coalesce(sum((value - p) * (value - p)), 0)), 5) as cid_ce,
round(case when max(n) > 1 then regr_slope(value, i) end, 6) as slope, round(case when max(n) > 2 then coalesce(avg(value * p * p2), 0) else 0 end, 3) as c3_1,
round(case when max(v) > 0 and max(n) > 1 then avg((value - m) * (p - m)) / max(v) end, 6) as acf_1, round(avg(cast(abs(value - m) > sqrt(v) as int)), 6) as beyond_1
from o group by user_id, event_type""")
def change_features(spark, d):
    names = {"mean_abs_change": ("mean_abs_change", 6), "absolute_sum_of_changes": ("absolute_sum_of_changes", 5), "count_above_mean": ("count_above_mean", 6), "count_below_mean": ("count_below_mean", 6), "abs_energy": ("abs_energy", 4), "q10": ("quantile__q_0.1", 6), "q90": ("quantile__q_0.9", 6), "cid_ce": ("cid_ce__normalize_False", 5), "slope": ("linear_trend__attr_slope", 6), "c3_1": ("c3__lag_1", 3), "acf_1": ("autocorrelation__lag_1", 6), "beyond_1": ("ratio_beyond_r_sigma__r_1", 6)}
    f = features.extract(_events(spark, d), ["user_id", "event_type"], [n for n, _ in names.values()])
    return f.select("user_id", "event_type", *[F.round(F.col(f"`{n}`"), k).alias(a) for a, (n, k) in names.items()])


@_query()
def efficient_features(spark, d):
    """All calculators of the efficient set over 8-hour windows of each sensor: expressions and Arrow families."""
    rows = _events(spark, d).withColumn("window_id", F.window("ts", "8 hours").start)
    return _out(features.extract_tall(rows, ["event_type", "window_id"]), "window_id")


@_query()
def arrow_features(spark, d):
    rows = _events(spark, d).withColumn("window_id", F.window("ts", "8 hours").start)
    return features.tall(_out(features.extract_arrow(rows, ["event_type", "window_id"]), "window_id"), ["event_type", "window_id"])


@_query("""with r as (select *, (row_number() over (partition by user_id, event_type order by ts desc) - 1) // 15 as block from events), c as (select user_id, event_type, block, count(*) as n, max(ts) as window_end, sum(value) as s from r group by all)
select user_id, event_type, cast(block as bigint) as block, window_end, round(s, 5) as total from c where n = 15""")
def roll_count(spark, d):
    r = align.roll_by_count(_events(spark, d), by=["user_id", "event_type"])
    return _out(r.groupBy("user_id", "event_type", "block", "window_end").agg(F.round(F.sum("value"), 5).alias("total")), "window_end")


@_query("""select event_id, user_id, last_value(case when event_type = 'error' then value end ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and current row) as error_value from events""")
def asof_fill(spark, d):
    e = _events(spark, d)
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("value").alias("error_value"))
    return align.asof(e.select("event_id", "user_id", "ts"), errors, ["error_value"], by=["user_id"]).select("event_id", "user_id", "error_value")


@_query("""with v as (select event_id, ts, case when event_id % 7 = 0 then value end as v from events)
select event_id, coalesce(last_value(v ignore nulls) over (order by ts rows between unbounded preceding and current row), first_value(v ignore nulls) over (order by ts rows between current row and unbounded following)) as v from v""")
def fill_both(spark, d):
    e = _events(spark, d).select("event_id", "ts", F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("v"))
    return align.fill(e, ["v"], backward=True, ties=["event_id"]).select("event_id", "v")


@_query("unpivot (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem) on l_quantity, l_extendedprice, l_discount, l_tax into name sensor value value")
def to_long(spark, d):
    return _table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "sensor", "value")


_WEATHER = "case event_type when 'view' then 'Mostly Cloudy' when 'click' then 'Rain,Fog' when 'error' then 'Thunderstorms' when 'signup' then 'Mainly Clear' end"


@_query(f"""with w as (select event_id, lower({_WEATHER}) as w from events), r as (select event_id, case when w is null then 'Unknown' when contains(w, 'thunder') then 'Thunderstorm' when contains(w, 'snow') then 'Snow' when contains(w, 'fog') then 'Fog' when contains(w, 'rain') or contains(w, 'drizzle') then 'Rain' when contains(w, 'cloud') then 'Cloudy' when contains(w, 'clear') or contains(w, 'sunny') then 'Clear' else 'Other' end as regime from w)
select event_id, regime, cast(regime = 'Clear' as int) as wx_Clear, cast(regime = 'Fog' as int) as wx_Fog, case regime when 'Cloudy' then 'Cloudy' when 'Fog' then 'Fog' when 'Rain' then 'Rain' else 'Clear' end as best from r""")
def weather_regime(spark, d):
    e = _events(spark, d).withColumn("regime", S.regime(F.expr(_WEATHER)))
    e = e.withColumns(S.one_hot(F.col("regime")))
    return e.select("event_id", "regime", "wx_Clear", "wx_Fog", S.idxmax(["wx_Clear", "wx_Cloudy", "wx_Fog", "wx_Rain"]).alias("best"))


@_query("""with e as (select event_id as e_id, user_id as e_user, ts as start from events where event_type = 'error')
select e_id, count(*) as n, round(sum(value), 5) as total from events join e on ts >= start and ts < start + interval '15 minutes' group by e_id""")
def interval_join(spark, d):
    e = _events(spark, d)
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("e_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 15 minutes")).alias("end"))
    return align.interval_join(e.select("ts", "value"), spans).groupBy("e_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@_query("""with b as (select time_bucket(interval '15 minutes', ts) as window_id, avg(value) as v from events group by all), g as (select unnest(generate_series(min(window_id), max(window_id), interval '15 minutes')) as window_id from b)
select g.window_id, round(v, 6) as v from g left join b using (window_id)""")
def full_grid(spark, d):
    b = align.resample(_events(spark, d).withColumnRenamed("value", "v"), ["v"])
    return _out(align.grid(b).select("window_id", F.round("v", 6).alias("v")), "window_id")


@_query("""with b as (select time_bucket(interval '15 minutes', ts) as window_id, avg(value) as value, max(cast(event_type = 'error' as int)) as wx_error from events group by all)
select window_id, round(value, 6) as value, wx_error, round(sin(2 * pi() * hour(window_id) / 24), 6) + 0.0::double as hour_sin, round(cos(2 * pi() * hour(window_id) / 24), 6) + 0.0::double as hour_cos, round(sin(2 * pi() * (isodow(window_id) - 1) / 7), 6) + 0.0::double as dow_sin, round(cos(2 * pi() * (isodow(window_id) - 1) / 7), 6) + 0.0::double as dow_cos, cast(isodow(window_id) >= 6 as int) as is_weekend from b""")
def context_vector(spark, d):
    e = _events(spark, d).withColumn("wx_error", (F.col("event_type") == "error").cast("int"))
    c = align.context_vector(e, ["value"], ["wx_error"])
    return _out(c.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in ("value", "hour_sin", "hour_cos", "dow_sin", "dow_cos")}), "window_id")


@_query("""with l as (select time_bucket(interval '15 minutes', ts) as window_id, arg_min(event_type, event_id) as anomaly_type from events where value > 450 group by all), w as (select distinct time_bucket(interval '15 minutes', ts) as window_id from events)
select w.window_id, cast(l.window_id is not null as int) as is_anomaly, coalesce(anomaly_type, 'normal') as anomaly_type from w left join l using (window_id)""")
def label_windows(spark, d):
    e = _events(spark, d).withColumn("window_id", align.bucket("ts"))
    log = align.first_by(e.where("value > 450").select("window_id", F.col("event_type").alias("anomaly_type"), "event_id"), ["window_id"], ["event_id"])
    return _out(align.label(e.select("window_id").distinct(), log), "window_id")


@_query("""select event_id, cast('0x' || substr(md5('42|' || cast(event_id as varchar)), 1, 8) as bigint) / 4294967296.0 * 2.0 + 1.0 as u from events""")
def seeded_uniform(spark, d):
    return _events(spark, d).select("event_id", S.uniform(F.col("event_id"), low=1, high=3, salt="42").alias("u"))


@_query("select event_id, value from events where hour(ts) between 2 and 5 order by md5('42|' || cast(event_id as varchar)) limit 80")
def seeded_sample(spark, d):
    return _events(spark, d).where(F.hour("ts").between(2, 5)).orderBy(S.rank_key(F.col("event_id"), salt="42")).limit(80).select("event_id", "value")


@_query("select event_type, round(quantile_cont(value, 0.75), 6) as q75, round(quantile_cont(value, 0.9), 6) as q90, round(quantile_cont(value, 0.95), 6) as q95, round(avg(value), 6) as mean, max(value) as top from events group by event_type")
def quantiles(spark, d):
    q = lambda p: F.round(F.percentile("value", p), 6)
    return _events(spark, d).groupBy("event_type").agg(q(0.75).alias("q75"), q(0.9).alias("q90"), q(0.95).alias("q95"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"))


@_query("select event_type, count(*) as n from events group by event_type")
def value_counts(spark, d):
    return evaluate.value_counts(_events(spark, d), "event_type")


@_query("select event_id, try_cast(replace(replace(props, '{\"k\": ', ''), '}', '') as double) as k from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-11'")
def coerce_and_slice(spark, d):
    from ..sources.io import number

    e = align.between_days(_events(spark, d), "ts", "2024-01-05", "2024-01-10")
    return e.select("event_id", number(F.regexp_replace("props", r'\{"k": |\}', "")).alias("k"))


@_query(f"""with {_TALL_SQL}, v as (select id, feature, case when id % 11 = 0 then null when id % 13 = 0 then cast('inf' as double) when id % 17 = 0 then cast('-inf' as double) else value end as value from tall),
s as (select feature, max(value) filter (where isfinite(value)) as hi, min(value) filter (where isfinite(value)) as lo, quantile_cont(case when isfinite(value) then value end, 0.5) as mid from v group by feature)
select id, feature, round(coalesce(case when value = cast('inf' as double) then hi when value = cast('-inf' as double) then lo when value is null then mid else value end, 0), 9) as value from v join s using (feature)""")
def impute(spark, d):
    v = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("inf")).when(F.col("id") % 17 == 0, float("-inf")).otherwise(F.col("value"))
    return select.impute(_tall(spark, d).withColumn("value", v)).select("id", "feature", F.round("value", 9).alias("value"))


@_query(f"with {_TALL_SQL}, s as (select feature, min(value) as lo, max(value) as hi from tall group by feature) select id, feature, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 9) as value from tall join s using (feature)")
def min_max(spark, d):
    return select.min_max(_tall(spark, d)).select("id", "feature", F.round("value", 9).alias("value"))


_MW_SQL = f"""with {_TALL_SQL}, r as (select feature, y, value, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as rk, count(*) over (partition by feature, value) as t from tall),
s as (select feature, cast(count(*) as double) as n, cast(sum(y) as double) as n1, sum(rk * y) as r1, sum(cast(t as double) * t - 1) as ties from r group by feature),
z as (select feature, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) - 0.5, 0) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) as z from s),
p as (select feature, z, 1 / (1 + 0.3275911 * (z / sqrt(2))) as t from z),
mw as (select feature, z, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) as p from p)"""


@_query(_MW_SQL + " select feature, round(z, 6) as z, round(p, 6) as p from mw")
def mann_whitney(spark, d):
    return select.mann_whitney(_tall(spark, d)).select("feature", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@_query(_MW_SQL + ", o as (select feature, p, row_number() over (order by p) as i, count(*) over () as m from mw), h as (select *, sum(1.0 / i) over () as c from o), k as (select max(i) filter (where p <= i * 0.05 / (m * c)) as last from h) select feature, round(p, 6) as p, i <= coalesce(last, 0) as kept from h, k")
def fresh_select(spark, d):
    return select.select(_tall(spark, d)).select("feature", F.round("p", 6).alias("p"), "kept")


@_query(f"""with {_TALL_SQL}, s as (select feature, min(value) as lo, max(value) as hi from tall group by feature), b as (select id, feature, case when hi > lo then least(9, cast(floor((value - lo) / ((hi - lo) / 10)) as int)) else 0 end as bin from tall join s using (feature)),
c as (select feature, bin, count(*) as c from b group by all), t as (select feature, bin, -log2(c * 1.0 / max(c) over (partition by feature) + 0.1) as s from c)
select id, round(sum(s), 6) as score from b join t using (feature, bin) group by id""")
def hbos(spark, d):
    return detect.hbos(_tall(spark, d)).select("id", F.round("score", 6).alias("score"))


_TAIL_SQL = f"""with {_TALL_SQL}, l as (select *, -ln(cume_dist() over (partition by feature order by value)) as l, -ln(cume_dist() over (partition by feature order by value desc)) as r from tall),
m as (select feature, avg(value) as mu from tall group by feature), k as (select feature, sum((value - mu) * (value - mu) * (value - mu)) as skew from tall join m using (feature) group by feature),
s as (select id, l, r, case when skew < 0 then l when skew > 0 then r else l + r end as s from l join k using (feature))"""


@_query(_TAIL_SQL + " select id, round(sum(greatest(l, r, s)), 6) as score from s group by id")
def ecod(spark, d):
    return detect.ecod(_tall(spark, d)).select("id", F.round("score", 6).alias("score"))


@_query(_TAIL_SQL + " select id, round(sum(greatest(s, (l + r) / 2)), 6) as score from s group by id")
def copod(spark, d):
    return detect.copod(_tall(spark, d)).select("id", F.round("score", 6).alias("score"))


@_query("""with v as (select vec_id as id, cast(embedding as double[]) as x from embeddings), p as (select a.id as id, b.id as nb, list_distance(a.x, b.x) as d from v a join v b on a.id <> b.id),
n as (select * from (select *, row_number() over (partition by id order by d, nb) as k from p) where k <= 20), kd as (select id as nb, max(d) as kdist from n group by id),
lrd as (select id, 1 / (avg(greatest(d, kdist)) + 1e-10) as lrd from n join kd using (nb) group by id)
select n.id as id, round(avg(o.lrd) / any_value(s.lrd), 6) as score from n join lrd o on n.nb = o.id join lrd s on n.id = s.id group by n.id""")
def lof(spark, d):
    return detect.lof(_vectors(spark, d)).select("id", F.round("score", 6).alias("score"))


@_query()
def isolation_forest(spark, d):
    return detect.isolation_forest(_vectors(spark, d))


@_query()
def auto_encoder(spark, d):
    return detect.auto_encoder(_vectors(spark, d))


@_query()
def variational_encoder(spark, d):
    return detect.variational(_vectors(spark, d))


def _scaled(spark, d) -> DataFrame:
    rows = select.min_max(_tall(spark, d))
    x = F.transform(F.array_sort(F.collect_list(F.struct(F.col("feature").cast("int").alias("f"), "value"))), lambda s: s["value"])
    return rows.groupBy("id", "y").agg(x.alias("x")).join(_vectors(spark, d).select("id", F.col("label").cast("string").alias("regime")), "id")


@_query()
def nmf_global(spark, d):
    rows = _scaled(spark, d)
    return factor.components(factor.transform(rows.select("id", "x"), factor.fit(rows, 5, rounds=2000)), 5, "id")


@_query()
def nmf_sweep(spark, d):
    return factor.sweep(_scaled(spark, d))


def _residuals(rows):
    """Every row's residual by one model of all, and by the model of its context (0 without one)."""
    whole = factor.transform(rows, factor.fit(rows, 5, rounds=2000)).drop("w").withColumnRenamed("residual", "global")
    models = factor.fit_by_context(rows, "regime", 5)
    return cut(factor.transform_by_context(whole, models, "regime").withColumnRenamed("residual", "context"), "residuals")


@_query()
def nmf_residual_report(spark, d):
    """Global residuals against context residuals: threshold at the 95th percentile of normal rows."""
    rows = _residuals(_scaled(spark, d))
    lines = [evaluate.report(evaluate.threshold(rows.select("y", F.col(c).alias("score"))), c) for c in ("global", "context")]
    return lines[0].unionByName(lines[1])


def _feature_sets(spark, d):
    """The scaled features alone, and with either residual as one more column."""
    rows = _residuals(_scaled(spark, d))
    sets = {"Behavior only": rows}
    for name in ("global", "context"):
        sets[f"Behavior + {name} residual"] = align.with_residual(rows, residual=name)
    return {n: cut(r.select("id", "x"), "features") for n, r in sets.items()}, rows.select("id", "y")


_SCORE_SQL = "with s as (select cast(event_type = 'error' as int) as y, user_id, value as score from events)"


@_query(_SCORE_SQL + ", r as (select user_id, y, rank() over (partition by user_id order by score) + (count(*) over (partition by user_id, score) - 1) / 2.0 as rk from s) select user_id, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) as auc_roc from r group by user_id")
def roc_auc(spark, d):
    rows = _events(spark, d).select((F.col("event_type") == "error").cast("int").alias("y"), "user_id", F.col("value").alias("score"))
    return evaluate.roc_auc(rows, ("user_id",)).select("user_id", F.round("auc_roc", 6).alias("auc_roc"))


@_query(_SCORE_SQL + ", c as (select quantile_cont(score, 0.95) filter (where y = 0) as cut from s), t as (select user_id, y, cast(score > cut as int) as p from s, c) select user_id, round(coalesce(sum(y * p) / nullif(sum(p), 0), 0), 6) as precision, round(coalesce(sum(y * p) / nullif(sum(y), 0), 0), 6) as recall, round(coalesce(2 * sum(y * p) / nullif(sum(p) + sum(y), 0), 0), 6) as f1, cast(sum(p) as bigint) as n_predicted, cast(sum(y) as bigint) as n_actual from t group by user_id")
def threshold_metrics(spark, d):
    rows = _events(spark, d).select((F.col("event_type") == "error").cast("int").alias("y"), "user_id", F.col("value").alias("score"))
    m = evaluate.precision_recall(evaluate.threshold(rows), ("user_id",))
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _as_tall(rows):
    return rows.select("id", F.posexplode("x").alias("feature", "value")).withColumn("feature", F.col("feature").cast("string"))


@_query()
def detector_grid(spark, d):
    """Five detectors on three sets of features."""
    sets, labels = _feature_sets(spark, d)
    known = {"IForest": detect.isolation_forest, "COPOD": lambda r: detect.copod(_as_tall(r)), "ECOD": lambda r: detect.ecod(_as_tall(r)), "HBOS": lambda r: detect.hbos(_as_tall(r)), "LOF": detect.lof}
    return evaluate.benchmark(sets, known, labels, 0.1)


@_query()
def deep_detector_grid(spark, d):
    """Both auto-encoders on three sets of features."""
    sets, labels = _feature_sets(spark, d)
    return evaluate.benchmark(sets, {"AutoEncoder": detect.auto_encoder, "VAE": detect.variational}, labels, 0.1)


@_query("select event_type, round(avg(value) filter (where user_id % 2 = 0), 6) as even, round(avg(value) filter (where user_id % 2 = 1), 6) as odd from events group by event_type")
def pivot_mean(spark, d):
    rows = _events(spark, d).select(F.col("event_type").alias("algorithm"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("features"), F.col("value").alias("auc_roc"))
    return evaluate.pivot(rows, ["even", "odd"]).select(F.col("algorithm").alias("event_type"), F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


@_query("select round(avg(cast(value > 450 as int)) * 100, 6) as anomaly_rate from events")
def anomaly_rate(spark, d):
    return evaluate.anomaly_rate(_events(spark, d).select((F.col("value") > 450).cast("int").alias("y"))).select(F.round("anomaly_rate", 6).alias("anomaly_rate"))


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
