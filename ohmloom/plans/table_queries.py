"""Registered queries of sources, sinks, reshaping, joins, aggregates, selection and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, detect, evaluate, factor, select
from ..sources import io
from .registry import TALL_SQL, events, out, query, table, tall, vectors


def _through_csv(rows, name: str, columns: list[str] | None = None, **how):
    path = io.scratch(rows.sparkSession, name)
    io.write_csv(rows, path, **how)
    return io.read_csv(rows.sparkSession, path, columns)


@query("select event_id, ts, value, value * 1.1 as P from events where event_type in ('view', 'click')")
def scan_mains(spark, d):
    """Mains as they come: epoch seconds under either name, numbers as text."""
    e = events(spark, d).where("event_type in ('view', 'click')")
    raw = _through_csv(e.select(F.unix_micros("ts").alias("UNIX_TS"), "event_id", F.col("value").alias("V"), (F.col("value") * 1.1).alias("P")), "mains")
    stamp = F.col(io.find_column(raw, "unix_ts", "timestamp")).cast("long")
    whole = S.epoch_time(F.floor(stamp / 1_000_000)) + F.make_dt_interval(secs=(stamp % 1_000_000).cast("decimal(18,6)") / 1_000_000)
    return out(raw.select(F.col("event_id").cast("long").alias("event_id"), whole.alias("ts"), io.number("V").alias("value"), io.number("P").alias("P")), "ts")


@query("select l_orderkey, l_linenumber, l_quantity as FRE, l_tax as HPE from lineitem where l_linenumber <= 2")
def scan_submeters(spark, d):
    """Of the channels wanted, those that are there."""
    rows = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("FRE"), F.col("l_tax").alias("HPE"))
    raw = _through_csv(rows, "submeters")
    found = io.present(raw, ("FRE", "HPE", "DWE", "CWE"))
    return raw.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), *[io.number(c).alias(c) for c in found])


_WEATHER = "case event_type when 'view' then 'Mostly Cloudy' when 'click' then 'Rain,Fog' when 'error' then 'Thunderstorms' end"


@query(f"select event_id, case when event_id % 5 = 0 then null else value end as temp, {_WEATHER} as weather from events")
def scan_weather(spark, d):
    """Column names with blanks and signs, commas inside a text, blanks and words where numbers should be; flags are dropped."""
    e = events(spark, d)
    temp = F.when(F.col("event_id") % 10 == 0, "M").when(F.col("event_id") % 5 == 0, "").otherwise(F.col("value").cast("string"))
    raw = _through_csv(e.select("event_id", temp.alias("Temp (C)"), F.expr(_WEATHER).alias("Weather"), F.lit("x").alias("Temp Flag")), "weather")
    kept = align.drop(raw, "Temp Flag", "Hmdx Flag")
    assert kept.columns == ["event_id", "Temp (C)", "Weather"]
    return kept.select(F.col("event_id").cast("long").alias("event_id"), io.number(F.col("`Temp (C)`")).alias("temp"), F.col("Weather").alias("weather"))


@query("select vec_id as window_id, cast(embedding[1] as double) as f0, cast(embedding[2] as double) as f1, cast(label as bigint) as label from embeddings")
def scan_feature_matrix(spark, d):
    """A matrix written with its key first, read back with types found in the data."""
    x = vectors(spark, d).select(F.get("x", F.lit(0)).alias("f0"), F.get("x", F.lit(1)).alias("f1"), "label", F.col("id").alias("window_id"))
    raw = _through_csv(x, "matrix", first="window_id")
    assert raw.columns[0] == "window_id"
    return align.repair(raw)


@query("select n_name as item, month, n_nationkey * 1.5 + k as value from nation, (select unnest(['Jan', 'Feb', 'Dec']) as month, unnest([0, 1, 2]) as k)")
def scan_normals(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("Item"), F.lit("detail").alias("Item Detail"), *[(F.col("n_nationkey") * 1.5 + k).alias(m) for k, m in enumerate(("Jan", "Feb", "Dec"))])
    return io.normals_long(_through_csv(n, "normals")).select(F.col("Item").alias("item"), "month", "value")


@query("select event_id, event_type, value from events where value > 200")
def sink_labels(spark, d):
    """The label log as CSV: the schema is given, quotes and types survive."""
    log = events(spark, d).where("value > 200").select("event_id", "event_type", "value")
    back = _through_csv(log, "labels", ["event_id", "event_type", "value"])
    return back.select(F.col("event_id").cast("long").alias("event_id"), "event_type", io.number("value").alias("value"))


@query("select event_id, user_id, event_type, value from events")
def sink_parquet(spark, d):
    path = io.scratch(spark, "sink")
    io.write_parquet(events(spark, d).select("event_id", "user_id", "event_type", "value"), path, ["event_type"])
    return io.read_parquet(spark, path).select("event_id", "user_id", F.col("event_type").cast("string").alias("event_type"), "value")


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def cached_stage(spark, d):
    """Computed once for its configuration; the second call reads."""
    root = io.scratch(spark, "stages")
    stage = lambda: events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    def never():
        raise AssertionError("computed twice")

    io.materialize(spark, root, "per_type", {"source": d, "digits": 4}, stage)
    return io.materialize(spark, root, "per_type", {"source": d, "digits": 4}, never)


@query("select event_id, date_trunc('second', ts) as at from events")
def epoch_to_ts(spark, d):
    return out(events(spark, d).select("event_id", S.epoch_time(F.unix_seconds("ts")).alias("at")), "at")


@query("select event_id, date_trunc('minute', ts) as wall from events")
def parse_mixed_formats(spark, d):
    """The same minutes written in three ways."""
    text = F.expr("case event_id % 3 when 0 then date_format(ts, 'yyyy-MM-dd HH:mm:00') when 1 then date_format(ts, 'M/d/yyyy H:mm') else date_format(ts, 'yyyy-MM-dd HH:mm') end")
    return events(spark, d).select("event_id", S.parse_mixed(text).alias("wall"))


_SHIFT = "case when event_id % 2 = 0 then timestamp '2012-03-01' + (ts - timestamp '2024-01-01') else timestamp '2012-10-20' + (ts - timestamp '2024-01-01') end"


@query(f"""with w as (select event_id, {_SHIFT} as wall from events)
select event_id, case when wall < timestamp '2012-03-11 02:00' then wall + interval '8 hours' when wall < timestamp '2012-03-11 03:00' then timestamp '2012-03-11 10:00' when wall < timestamp '2012-11-04 01:00' then wall + interval '7 hours'
  when wall < timestamp '2012-11-04 02:00' then null else wall + interval '8 hours' end as utc from w""")
def local_time(spark, d):
    """Wall clocks around both changes of a year: a gap moves forward, an ambiguous hour is null."""
    base = F.when(F.col("event_id") % 2 == 0, F.lit("2012-03-01")).otherwise(F.lit("2012-10-20")).cast("timestamp_ntz")
    e = table(spark, d, "events").withColumn("wall", base + (F.col("ts").cast("timestamp_ntz") - F.lit("2024-01-01").cast("timestamp_ntz")))
    return out(e.select("event_id", S.localize(F.col("wall"), "America/Vancouver").alias("utc")), "utc")


@query("select event_id, value from events where user_id % 3 <> 0")
def not_null_key(spark, d):
    e = events(spark, d).withColumn("key", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return e.where(F.col("key").isNotNull()).select("event_id", "value")


@query("select event_id, event_id * 2 as whole, value as real, event_type as text from events")
def repaired_types(spark, d):
    e = events(spark, d).select(*[c.cast("string").alias(n) for n, c in (("event_id", F.col("event_id")), ("whole", F.col("event_id") * 2), ("real", F.col("value")), ("text", F.col("event_type")))])
    return align.repair(e)


@query("unpivot (select ts, value as P, value * 2 as Q, 'house' as entity_id from events) on P, Q into name sensor value value")
def long_stream(spark, d):
    e = events(spark, d).select("ts", F.col("value").alias("P"), (F.col("value") * 2).alias("Q"))
    return out(align.to_long(e, ["P", "Q"]), "ts")


_MINUTE = "select date_trunc('minute', ts) as ts, avg(value) as {1} from events where event_type = '{0}' group by all"


@query(f"with a as ({_MINUTE.format('view', 'P')}), z as ({_MINUTE.format('click', 'FRE')}) select ts, round(P, 6) as P, round(FRE, 6) as FRE from a join z using (ts)")
def inner_join_ts(spark, d):
    minute = lambda kind, name: events(spark, d).where(F.col("event_type") == kind).groupBy(F.date_trunc("minute", "ts").alias("ts")).agg(F.round(F.avg("value"), 6).alias(name))
    return out(align.inner(minute("view", "P"), minute("click", "FRE")), "ts")


@query("select count(distinct time_bucket(interval '15 minutes', ts)) as windows, bool_or(value > 490) as any_high from events")
def distinct_windows(spark, d):
    return events(spark, d).agg(F.count_distinct(align.bucket("ts")).alias("windows"), F.bool_or(F.col("value") > 490).alias("any_high"))


@query("select distinct event_type, user_id from events")
def distinct_values(spark, d):
    return events(spark, d).select("event_type", "user_id").distinct()


@query("select event_id, ts from events where ts < (select min(ts) from (select ts from events order by ts desc limit 90))")
def drop_last_rows(spark, d):
    return out(align.drop_last(events(spark, d).select("event_id", "ts"), 90), "ts")


@query("select event_id, ts, value from events order by ts limit 5")
def head_by_time(spark, d):
    return out(events(spark, d).select("event_id", "ts", "value").orderBy("ts").limit(5), "ts")


@query("""with r as (select *, row_number() over (partition by event_type order by ts desc) - 1 as at, count(*) over (partition by event_type) as n from events),
w as (select event_type, unnest(range(0, (max(n) - 15) // 5 + 1)) as block from r group by event_type)
select w.event_type, w.block, max(r.ts) as window_end, round(sum(r.value), 5) as total from w join r on r.event_type = w.event_type and r.at between 5 * block and 5 * block + 14 group by w.event_type, w.block""")
def overlapping_count_windows(spark, d):
    r = align.roll_by_count(events(spark, d), by=["event_type"], stride=5)
    return out(r.groupBy("event_type", "block", "window_end").agg(F.round(F.sum("value"), 5).alias("total")), "window_end")


@query("select time_bucket(interval '15 minutes', ts) as window_id, event_type, count(*) as n from events group by all")
def tumbling_windows(spark, d):
    return out(align.roll_by_time(events(spark, d)).groupBy("window_id", "event_type").agg(F.count("*").alias("n")), "window_id")


@query("select page_id, split_part(url, '/', 3) as host, try_cast(regexp_extract(url, '([0-9]+)', 1) as bigint) as number from pages")
def split_and_parse(spark, d):
    return table(spark, d, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.regexp_extract("url", "([0-9]+)", 1).try_cast("long").alias("number"))


@query("""with v as (select vec_id as id, label, cast(embedding as double[]) as x from embeddings), c as (select label, list(c order by k) as c from (select label, k, avg(e) as c from (select label, unnest(range(64)) as k, unnest(x) as e from v) group by all) group by label)
select id, round(list_sum(list_transform(range(1, 65), lambda i: pow(x[i] - c[i], 2))) / 64, 8) as residual, 65 as width from v join c using (label)""")
def residual_column(spark, d):
    """Each row against its group's mean vector; the residual becomes the last column of the features."""
    v = vectors(spark, d)
    at = v.select("label", F.posexplode("x").alias("k", "e")).groupBy("label", "k").agg(F.avg("e").alias("e"))
    mean = at.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda s: s["e"]).alias("mean"))  # one vector a label
    rows = align.with_residual(v.join(mean, "label").withColumn("residual", align.row_error(F.col("x"), F.col("mean"))))
    return rows.select("id", F.round(F.element_at("x", -1), 8).alias("residual"), F.size("x").alias("width"))


@query("""with v as (select vec_id as id, cast(embedding as double[]) as x from embeddings), h as (select id as k, x as h from v where id < 3)
select v.id, cast(h.k as int) as k, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * h[i])), 8) as product from v, h""")
def matrix_product(spark, d):
    """Rows times the transpose of a small matrix that every task gets."""
    v = vectors(spark, d).select("id", "x")
    h = [r.x for r in v.where("id < 3").orderBy("id").collect()]  # three rows
    products = F.array(*[F.aggregate(F.zip_with("x", F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p) for row in h])
    return v.select("id", F.posexplode(products).alias("k", "p")).select("id", "k", F.round("p", 8).alias("product"))


_HBOS = f"""with {TALL_SQL}, s as (select feature, min(value) as lo, max(value) as hi from tall group by feature), b as (select id, feature, case when hi > lo then least(9, cast(floor((value - lo) / ((hi - lo) / 10)) as int)) else 0 end as bin from tall join s using (feature)),
c as (select feature, bin, count(*) as c from b group by all), t as (select feature, bin, -log2(c * 1.0 / max(c) over (partition by feature) + 0.1) as s from c), scored as (select id, round(sum(s), 6) as score from b join t using (feature, bin) group by id)"""


@query(_HBOS + " select id, score, cast(score > (select quantile_cont(score, 0.9) from scored) as int) as is_outlier from scored")
def contamination_label(spark, d):
    return detect.flag(detect.hbos(tall(spark, d)).withColumn("score", F.round("score", 6)), 0.1)


_TWO = "with s as (select cast(event_type = 'error' as int) as y, value as a, -value + event_id % 7 as b from events)"


def _auc_sql(score: str) -> str:
    return f"(select (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) from (select y, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as rk from s))"


def _two_scores(spark, d):
    e = events(spark, d).select((F.col("event_type") == "error").cast("int").alias("y"), "event_id", "value")
    return e.select("y", F.col("value").alias("score")), e.select("y", (-F.col("value") + F.col("event_id") % 7).alias("score"))


@query(f"{_TWO} select round({_auc_sql('a')} - {_auc_sql('b')}, 6) as lift")
def model_lift(spark, d):
    a, b = _two_scores(spark, d)
    return evaluate.lift(evaluate.roc_auc(a), evaluate.roc_auc(b)).select(F.round("lift", 6).alias("lift"))


def _report_sql(name: str, score: str) -> str:
    hit = f"cast({score} > (select quantile_cont({score}, 0.95) filter (where y = 0) from s) as int)"
    return (
        f"select '{name}' as model, sum(p) as n_predicted, sum(y) as n_actual, round({_auc_sql(score)}, 3) as auc_roc, round(coalesce(2 * sum(y * p) / nullif(sum(p) + sum(y), 0), 0), 3) as f1, "
        f"round(coalesce(sum(y * p) / nullif(sum(p), 0), 0), 3) as precision, round(coalesce(sum(y * p) / nullif(sum(y), 0), 0), 3) as recall from (select y, {hit} as p from s)"
    )


@query(f"{_TWO} select model, cast(n_predicted as bigint) as n_predicted, cast(n_actual as bigint) as n_actual, auc_roc, f1, precision, recall from ({_report_sql('a', 'a')} union all {_report_sql('b', 'b')})")
def detection_report(spark, d):
    a, b = _two_scores(spark, d)
    return evaluate.report(evaluate.threshold(a), "a").unionByName(evaluate.report(evaluate.threshold(b), "b"))


@query(f"""with {TALL_SQL}, b as (select feature, y, cast(value > 0 as int) as value from tall), c as (select feature, cast(count(*) as double) as n, cast(sum(y) as double) as n1, cast(sum(value) as double) as k, cast(sum(y * value) as double) as a from b group by feature having max(value) > min(value)),
x as (select *, unnest(range(cast(greatest(0, n1 - (n - k)) as bigint), cast(least(k, n1) as bigint) + 1)) as j from c),
p as (select feature, j, a, lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(n - k + 1) - lgamma(n1 - j + 1) - lgamma(n - k - n1 + j + 1) - lgamma(n + 1) + lgamma(n1 + 1) + lgamma(n - n1 + 1) as lp from x)
select feature, round(least(1.0, sum(exp(lp)) filter (where lp <= seen + 1e-7)), 6) as p from p join (select feature, lp as seen from p where j = a) using (feature) group by feature""")
def fisher_binary(spark, d):
    return select.fisher(tall(spark, d).withColumn("value", (F.col("value") > 0).cast("double"))).select("feature", F.round("p", 6).alias("p"))


_BEHAVIOUR = ", ".join(f"avg(value) filter (where event_type = '{k}') as \"{k}__mean\"" for k in ("click", "error", "purchase", "signup", "view"))


@query(f"""with w as (select time_bucket(interval '2 hours', ts) as window_id, * from events), b as (select window_id, {_BEHAVIOUR} from w group by window_id),
c as (select window_id, max(cast(event_type = 'error' as int)) as wx_error, avg(value) as level from w group by window_id), l as (select window_id, arg_min(event_type, event_id) as anomaly_type from w where value > 480 group by window_id)
select window_id, {", ".join(f'round("{k}__mean", 6) as "{k}__mean"' for k in ("click", "error", "purchase", "signup", "view"))}, wx_error, round(level, 6) as level, cast(l.window_id is not null as int) as is_anomaly, coalesce(anomaly_type, 'normal') as anomaly_type
from b join c using (window_id) left join l using (window_id) where not ("click__mean" is null or "error__mean" is null or "purchase__mean" is null or "signup__mean" is null or "view__mean" is null)""")
def final_matrix(spark, d):
    """Features of every sensor beside their window's context, complete rows only, labelled."""
    w = events(spark, d).withColumn("window_id", align.bucket("ts", "2 hours"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    behaviour = w.groupBy("window_id").pivot("event_type", kinds).agg(F.round(F.avg("value"), 6))
    behaviour = behaviour.select("window_id", *[F.col(k).alias(f"{k}__mean") for k in kinds])
    context = w.groupBy("window_id").agg(F.max((F.col("event_type") == "error").cast("int")).alias("wx_error"), F.round(F.avg("value"), 6).alias("level"))
    log = align.first_by(w.where("value > 480").select("window_id", F.col("event_type").alias("anomaly_type"), "event_id"), ["window_id"], ["event_id"])
    rows = align.final_matrix(behaviour, context, log)
    assert align.complement(rows, ["window_id", "is_anomaly", "anomaly_type", "wx_error", "level"]) == [f"{k}__mean" for k in kinds]
    return out(rows, "window_id")


@query("select label, count(*) as n from embeddings group by label having count(*) >= 50")
def contexts_with_a_model(spark, d):
    """A context of too few rows gets no model."""
    rows = vectors(spark, d).withColumn("context", F.col("label").cast("string")).withColumn("x", F.transform("x", F.abs))
    models = factor.fit_by_context(rows, "context", 2, least=50, rounds=2)
    scored = factor.transform_by_context(rows, models, "context").where("scored")
    return scored.groupBy("label").agg(F.count("*").alias("n"))
