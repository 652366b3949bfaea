import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmloom.functions import scalars as S
from ohmloom.operators import align, detect, evaluate, factor, features, inject, select


def test_regime_order_and_unknown(spark):
    rows = spark.createDataFrame([("Rain,Fog",), ("Mostly Cloudy",), ("",), (None,), ("Thunderstorms,Rain",), ("Drizzle",)], "w string")
    got = [r[0] for r in rows.select(S.regime(F.col("w"))).collect()]
    assert got == ["Fog", "Cloudy", "Other", "Unknown", "Thunderstorm", "Rain"]


def test_idxmax_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "wx_Clear int, wx_Rain int")
    assert [r[0] for r in rows.select(S.idxmax(["wx_Clear", "wx_Rain"])).collect()] == ["Clear", "Rain", "Clear"]


def test_fill_crosses_days_and_keeps_leading_nulls(spark):
    t = dt.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(t + dt.timedelta(hours=12 * i), v) for i, v in enumerate([None, 1.0, None, None, 2.0, None])], "ts timestamp, v double")
    got = [r.v for r in align.fill(rows, ["v"]).orderBy("ts").collect()]
    assert got == [None, 1.0, 1.0, 1.0, 2.0, 2.0]
    assert [r.v for r in align.fill(rows, ["v"], backward=True).orderBy("ts").collect()][0] == 1.0


def test_count_windows_drop_the_head(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "s", t + dt.timedelta(minutes=i), float(i)) for i in range(32)], "entity_id string, sensor string, ts timestamp, value double")
    got = align.roll_by_count(rows).groupBy("block").agg(F.count("*").alias("n"), F.min("value").alias("lo")).orderBy("block").collect()
    assert [(r.block, r.n, r.lo) for r in got] == [(0, 15, 17.0), (1, 15, 2.0)]


def test_scaler_constant_is_zero_and_impute(spark):
    rows = spark.createDataFrame([(1, "c", 3.0), (2, "c", 3.0), (1, "v", 0.0), (2, "v", 4.0)], "id int, feature string, value double")
    got = {(r.id, r.feature): r.value for r in select.min_max(rows).collect()}
    assert got == {(1, "c"): 0.0, (2, "c"): 0.0, (1, "v"): 0.0, (2, "v"): 1.0}
    bad = spark.createDataFrame([(1, "f", float("inf")), (2, "f", None), (3, "f", 1.0), (4, "f", 3.0), (5, "g", float("nan"))], "id int, feature string, value double")
    assert {r.id: r.value for r in select.impute(bad).collect()} == {1: 3.0, 2: 2.0, 3: 1.0, 4: 3.0, 5: 0.0}


def test_auc_with_ties_and_zero_division(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "y int, score double")
    assert evaluate.roc_auc(rows).first()[0] == pytest.approx(0.875)
    none = rows.withColumn("predicted", F.lit(0))
    assert evaluate.precision_recall(none).first()[:3] == (0.0, 0.0, 0.0)


def test_features_against_numpy(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t + dt.timedelta(minutes=i), v) for i, v in enumerate(x)], "w int, ts timestamp, value double")
    names = ["mean", "standard_deviation", "median", "longest_strike_above_mean", "fft_coefficient__attr_real__coeff_1", "linear_trend__attr_slope", "number_peaks__n_1", "autocorrelation__lag_1", "skewness"]
    got = features.extract(rows, ["w"], names).first()
    a = np.array(x)
    m = a - a.mean()
    want = [a.mean(), a.std(), np.median(a), 2, np.fft.rfft(a)[1].real, np.polyfit(range(8), a, 1)[0], 2, (m[:-1] * m[1:]).mean() / a.var(), 8 / 7 / 6 * 8 * (m**3).mean() / a.std(ddof=1) ** 3]
    assert [got[n] for n in names] == pytest.approx(want)


def test_nmf_residual_falls_and_stays_positive(spark):
    rng = np.random.default_rng(1)
    x = rng.random((60, 3)) @ rng.random((3, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    errors = []
    for k in (1, 3):
        h = factor.fit(rows, k, rounds=8)
        assert (h >= 0).all()
        errors.append(factor.transform(rows, h).agg(F.avg("residual")).first()[0])
    assert errors[1] < errors[0]


def test_detectors_rank_the_planted_outlier(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    x[7] = 9
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    tall = vectors.select("id", F.posexplode("x").alias("feature", "value")).withColumn("feature", F.col("feature").cast("string"))
    for scores in (detect.hbos(tall), detect.ecod(tall), detect.copod(tall), detect.lof(vectors), detect.isolation_forest(vectors, trees=20)):
        assert scores.orderBy(F.desc("score")).first()[0] == 7


def test_injection_is_repeatable_and_local(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t + dt.timedelta(minutes=i), float(i % 7)) for i in range(600)], "ts timestamp, P double")
    pack = [inject.Injector("power_spike", 3, 15, ("P",), "add", ((900, 1700),))]
    changed, log = inject.run(rows, pack)
    again, _ = inject.run(rows, pack)
    a, b = ({r.ts: r.P for r in d.collect()} for d in (changed, again))
    assert a == b and 1 <= log.count() <= 3
    moved = [k for k, v in a.items() if v > 100]
    assert 15 <= len(moved) <= 45
    assert sum(i.n * max(1, i.minutes // 15) for i in inject.current_pack()) == 830
    assert sum(i.n * max(1, i.minutes // 15) for i in inject.first_pack()) == 95


def test_expressions_against_numpy_on_all_lengths(spark):
    rng = np.random.default_rng(3)
    t = dt.datetime(2024, 1, 1)
    windows = {n: np.round(rng.normal(0, 2, n), 1) for n in (1, 2, 3, 4, 7, 15, 23)} | {99: np.full(9, 1.5)}
    rows = spark.createDataFrame([(w, t + dt.timedelta(minutes=i), float(v)) for w, x in windows.items() for i, v in enumerate(x)], "w int, ts timestamp, value double")
    names = ["variance", "skewness", "kurtosis", "number_crossing_m__m_0", "percentage_of_reoccurring_datapoints_to_all_datapoints", "sum_of_reoccurring_values", "index_mass_quantile__q_0.5",
             "energy_ratio_by_chunks__num_segments_10__segment_focus_2", "change_quantiles__f_agg_var__isabs_True__qh_0.8__ql_0.2", "binned_entropy__max_bins_10", "agg_linear_trend__attr_stderr__chunk_len_5__f_agg_mean"]
    got = {r.w: r for r in features.extract(rows, ["w"], names).collect()}
    for w, x in windows.items():
        n, values, counts = len(x), *np.unique(x, return_counts=True)
        chunks = np.array_split(x, 10)
        lo, hi = np.quantile(x, 0.2), np.quantile(x, 0.8)
        inside = (x >= lo - 1e-12) & (x <= hi + 1e-12)
        steps = np.abs(np.diff(x))[inside[1:] & inside[:-1]]
        p = np.histogram(x, 10)[0] / n if np.ptp(x) else np.array([1.0])
        want = {
            "variance": x.var(), "number_crossing_m__m_0": float((np.diff((x > 0).astype(int)) != 0).sum()), "percentage_of_reoccurring_datapoints_to_all_datapoints": counts[counts > 1].sum() / n,
            "sum_of_reoccurring_values": values[counts > 1].sum(), "index_mass_quantile__q_0.5": (np.argmax(np.cumsum(np.abs(x)) >= 0.5 * np.abs(x).sum() - 1e-12) + 1) / n if np.abs(x).sum() else None,
            "energy_ratio_by_chunks__num_segments_10__segment_focus_2": (chunks[2] ** 2).sum() / (x**2).sum() if (x**2).sum() else None,
            "change_quantiles__f_agg_var__isabs_True__qh_0.8__ql_0.2": steps.var() if len(steps) else 0.0, "binned_entropy__max_bins_10": -(p[p > 0] * np.log(p[p > 0])).sum(),
        }
        for k, v in want.items():
            assert got[w][k] == pytest.approx(v, abs=1e-9), (w, k)
        assert (got[w]["skewness"] is None) == (n < 3) and (got[w]["kurtosis"] is None) == (n < 4)
    assert got[99]["skewness"] == 0 and got[2]["agg_linear_trend__attr_stderr__chunk_len_5__f_agg_mean"] is None


def test_arrow_families():
    rng = np.random.default_rng(5)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    names = features.arrow_names()
    assert len(names) == len(set(names)) and not set(names) & set(features.efficient())
    got = features.compute([walk, noise, noise[:15], noise[:1], np.ones(12), np.zeros(0)], [*names, "sample_entropy", "approximate_entropy__m_2__r_0.2"])
    at = {n: i for i, n in enumerate(names)}
    assert got[0, at["augmented_dickey_fuller__attr_pvalue"]] > 0.1 > 1e-6 > got[1, at["augmented_dickey_fuller__attr_pvalue"]]
    # lags from half the length on have no partial autocorrelation
    assert [np.isnan(got[2, at[f"partial_autocorrelation__lag_{k}"]]) for k in range(10)] == [False] * 7 + [True] * 3
    f = np.fft.rfft(noise)
    assert got[1, at["fft_coefficient__attr_imag__coeff_42"]] == pytest.approx(f[42].imag)
    assert got[1, at["fft_coefficient__attr_angle__coeff_42"]] == pytest.approx(np.degrees(np.angle(f[42])))
    design = np.column_stack([np.ones(290), *(noise[10 - i : 300 - i] for i in range(1, 11))])
    assert got[1, at["ar_coefficient__coeff_3__k_10"]] == pytest.approx(np.linalg.lstsq(design, noise[10:], rcond=None)[0][3])
    kernel = features.ricker(50, 5)
    assert got[1, at["cwt_coefficients__coeff_7__w_5"]] == pytest.approx(np.convolve(noise, kernel, "same")[7])
    slope = np.polyfit(np.arange(300), noise, 1)[0]
    assert slope and 0 < got[1, at["linear_trend__attr_pvalue"]] <= 1
    assert got[1, at["lempel_ziv_complexity__bins_10"]] > got[4, at["lempel_ziv_complexity__bins_10"]]
    assert np.isnan(got[5]).all()
    r = [float((noise[: 300 - k] - noise.mean()) @ (noise[k:] - noise.mean())) / (300 - k) / noise.var() for k in range(1, 41)]
    assert got[1, at["agg_autocorrelation__f_agg_median__maxlag_40"]] == pytest.approx(np.median(r))
    x = noise[:40]
    assert features.query_similarity_count(x, x[5:12] * 3 + 1, 0.0) == 1 and features.query_similarity_count(x) == 0
    again = np.concatenate([x[:10], x[:10] * 2, x[20:30], x[30:]])
    assert features.matrix_profile(again)[0] == pytest.approx(0, abs=1e-6)


def test_every_calculator_gives_a_row(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(w, t + dt.timedelta(minutes=i), float((i * 7 + w) % 5)) for w in (1, 2) for i in range(20 * w - 19)], "w int, ts timestamp, value double")
    tall = features.extract_tall(rows, ["w"])
    assert tall.groupBy("w").agg(F.count_distinct("feature").alias("n")).where(F.col("n") == len(features.efficient()) + len(features.arrow_names())).count() == 2


def test_csv_and_cached_stages(spark, tmp_path):
    from ohmloom.sources import io

    rows = spark.createDataFrame([(1, "a,b", "7"), (2, 'say "x"', " 2 "), (3, None, "abc"), (4, "", "NaN")], "UNIX_TS long, name string, v string")
    io.write_csv(rows, f"file://{tmp_path}/one", first="v", single=True)
    back = io.read_csv(spark, f"file://{tmp_path}/one")
    assert back.columns == ["v", "UNIX_TS", "name"] and io.find_column(back, "time", "unix_ts") == "UNIX_TS"
    assert {r.UNIX_TS: r.n for r in back.select("UNIX_TS", io.number("v").alias("n")).collect()} == {"1": 7.0, "2": 2.0, "3": None, "4": None}
    assert [r.name for r in back.orderBy("UNIX_TS").limit(2).collect()] == ["a,b", 'say "x"']
    calls = []
    stage = lambda: calls.append(1) or rows
    for config in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert io.materialize(spark, f"file://{tmp_path}/stages", "s", config, stage).count() == 4
    assert len(calls) == 2
    with pytest.raises(KeyError):
        io.find_column(back, "nothing")


def test_times_and_zones(spark):
    texts = [("2012-03-11 02:30:00",), ("3/11/2012 2:30",), ("2012-11-04 01:30",), ("2012-07-01 12:00:00",), ("soon",), (None,)]
    got = spark.createDataFrame(texts, "t string").select(S.localize(S.parse_mixed(F.col("t")), "America/Vancouver").alias("at")).collect()
    at = lambda *a: dt.datetime(*a)
    shown = [None if r.at is None else r.at.astimezone(dt.timezone.utc).replace(tzinfo=None) for r in got]
    assert shown == [at(2012, 3, 11, 10), at(2012, 3, 11, 10), None, at(2012, 7, 1, 19), None, None]


def test_types_are_repaired_and_rows_dropped(spark):
    rows = spark.createDataFrame([("1", "1.5", "x", None), ("2", None, "y", None)], "a string, b string, c string, d string")
    assert [t for _, t in align.repair(rows).dtypes][:3] == ["bigint", "double", "string"]
    t = dt.datetime(2024, 1, 1)
    times = spark.createDataFrame([(t + dt.timedelta(minutes=i),) for i in range(10)], "ts timestamp")
    assert align.drop_last(times, 3).count() == 7 and align.drop_last(times, 0).count() == 10 and align.drop_last(times, 20).count() == 0
    holes = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "i int, v double")
    assert [r.i for r in align.drop_incomplete(holes).collect()] == [1]


def test_overlapping_count_windows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("e", "s", t + dt.timedelta(minutes=i), float(i)) for i in range(21)], "entity_id string, sensor string, ts timestamp, value double")
    got = {r.block: (r.n, r.lo, r.hi) for r in align.roll_by_count(rows, 10, stride=4).groupBy("block").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    assert got == {0: (10, 11.0, 20.0), 1: (10, 7.0, 16.0), 2: (10, 3.0, 12.0)}


def test_stream_windows_equal_the_batch(spark, tmp_path):
    from ohmloom.streaming.windows import windowed

    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("e", "s", t + dt.timedelta(minutes=3 * i), float(i % 4)) for i in range(40)], "entity_id string, sensor string, ts timestamp, value double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = windowed(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.window_id: (r.length, r.sum_values) for r in spark.table("windowed").collect()}
    want = {r.w: (r.n, r.s) for r in rows.groupBy(align.bucket("ts").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == want and len(got) == 8


def test_running_sums_over_parts(spark):
    from ohmloom.operators.ranks import running

    rows = spark.createDataFrame([(k, float(i), i % 3 + 1) for k in ("a", "b", None) for i in range(50)], "k string, v double, c long").repartition(7)
    got = {(r.k, r.v): (r.upto, r.total) for r in running(rows, ["k"], "v", "c", total="total").collect()}
    sums = np.cumsum([i % 3 + 1 for i in range(50)])
    assert got == {(k, float(i)): (int(sums[i]), int(sums[-1])) for k in ("a", "b", None) for i in range(50)}


def test_fisher_against_enumeration(spark):
    from math import comb

    y, v = [1] * 7 + [0] * 9, [1, 1, 1, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0]
    rows = spark.createDataFrame([("f", float(a), b) for a, b in zip(v, y)], "feature string, value double, y int")
    n, n1, k, a = 16, 7, sum(v), 5
    chance = {x: comb(k, x) * comb(n - k, n1 - x) / comb(n, n1) for x in range(max(0, n1 - n + k), min(k, n1) + 1)}
    assert select.fisher(rows).first().p == pytest.approx(sum(p for p in chance.values() if p <= chance[a] * (1 + 1e-7)))


def test_contexts_are_fitted_as_by_themselves(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, "ab"[i % 2], (rng.random(2) @ rng.random((2, 6)) + (i % 2)).tolist()) for i in range(60)] + [(99, "c", [1.0] * 6)], "id int, context string, x array<double>")
    models = factor.fit_by_context(rows, "context", 2, rounds=15)
    assert set(models) == {"a", "b"}
    for c, h in models.items():
        assert h == pytest.approx(factor.fit(rows.where(F.col("context") == c), 2, rounds=15), rel=1e-6)
    scored = {r.id: (r.residual, r.scored) for r in factor.transform_by_context(rows, models, "context").collect()}
    assert scored[99] == (0.0, False) and all(s for i, (_, s) in scored.items() if i != 99)
    assert [r.k for r in factor.sweep(rows, (1, 2), rounds=5).orderBy("k").collect()] == [1, 2]


def test_encoders_train_on_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2)) @ rng.normal(size=(2, 6))
    x[11] = 8
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for parts in (1, 3):
        monkeypatch.setattr(detect, "TRAIN_ROWS", -(-150 // parts))
        for make in (detect.auto_encoder, detect.variational):
            scores = make(rows, epochs=6)
            assert scores.orderBy(F.desc("score")).first()[0] == 11 and scores.count() == 150
    assert detect.auto_encoder(rows.limit(0)).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 5))
    x[40:60] = x[40]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r.id, r.place): (r.neighbour, r.dist) for r in detect.neighbours(rows, 6, blocks=4).collect()}
    for i in range(90):
        best = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(90) if j != i)[:6]
        assert [got[i, k + 1][0] for k in range(6)] == [j for _, j in best]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_backward_fill_of_a_long_day_ends(spark):
    rows = spark.range(150_000).select("id", F.timestamp_micros((F.col("id") / 3).cast("long") * 60_000).alias("ts"), F.when(F.col("id") == 149_998, F.col("id")).alias("v"))
    begun = time.time()
    got = align.fill(rows, ["v"], backward=True, ties=["id"]).agg(F.count("v"), F.sum("v")).first()
    assert tuple(got) == (150_000, 150_000 * 149_998) and time.time() - begun < 30


def test_fill_orders_rows_of_one_instant(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, t, v) for i, v in ((3, None), (0, None), (2, 2.0), (4, 4.0), (1, 1.0))] + [(5, t + dt.timedelta(days=1), None)], "id long, ts timestamp, v double")
    assert [r.v for r in align.fill(rows, ["v"], backward=True, ties=["id"]).orderBy("id").collect()] == [1.0, 1.0, 2.0, 2.0, 4.0, 4.0]


def test_density_of_a_long_window_is_one_piece():
    x = np.random.default_rng(5).normal(size=300)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(300) / 300)
    plain = 2 * np.abs(np.fft.rfft((x - x.mean()) * hann)) ** 2 / (hann**2).sum()
    got = features.compute([x, x[:200], x[:1]], [f"spkt_{how}density__coeff_{k}" for how in ("", "welch_") for k in (2, 5, 8)])
    assert got[0, :3] == pytest.approx(plain[[2, 5, 8]]) and got[1, :3] == pytest.approx(got[1, 3:]) and np.isnan(got[2]).all()
    assert not np.allclose(got[0, :3], got[0, 3:])


def test_mean_does_not_hang_on_how_rows_are_dealt(spark):
    x = [0.4, 2.73, 9.64, 13.2, 19.34, 37.53, 39.27, 42.74, 52.04, 56.99, 65.17, 132.19] * 60
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t + dt.timedelta(seconds=i), v) for i, v in enumerate(x)], "k string, ts timestamp, value double")
    total = 0.0
    for v in x:
        total += v
    want = (sum(v > total / len(x) for v in x), sum(v < total / len(x) for v in x))
    for parts in (1, 3, 7, 60):
        assert tuple(features.extract(rows.repartition(parts), ["k"], ["count_above_mean", "count_below_mean"]).first()[1:]) == want


def test_entropies_and_profile_of_long_windows():
    rng = np.random.default_rng(8)
    for x in (np.round(rng.exponential(50, 700), 1), np.repeat(np.round(rng.normal(size=60), 1), 12), np.tile([1.0, 2.0, 5.0, 2.0], 150), rng.normal(size=5), np.arange(4.0)):
        n, far = len(x), 0.2 * x.std()
        table = {k: (np.abs(np.lib.stride_tricks.sliding_window_view(x, k)[:, None] - np.lib.stride_tricks.sliding_window_view(x, k)).max(2) <= far) for k in (2, 3)}
        long, short = table[3].sum() - (n - 2), table[2][: n - 2, : n - 2].sum() - (n - 2)
        sample = -np.log(long / short) if long and short else np.nan
        assert features.entropies(x) == pytest.approx([sample, abs(np.log(table[2].mean(1)).mean() - np.log(table[3].mean(1)).mean())], nan_ok=True)
        if n > 100:
            k = n // 4
            assert features._nearest_by_diagonals(x, k, 20) == pytest.approx(features._nearest(x, k, 20), abs=1e-6)
    level = np.concatenate([rng.normal(size=200), np.zeros(150), rng.normal(size=100), np.ones(150), rng.normal(size=100)])
    assert features._nearest_by_diagonals(level, 100, 25) == pytest.approx(features._nearest(level, 100, 25), abs=1e-6)
    begun = time.time()
    big = np.repeat(rng.normal(size=300), 40)
    assert np.isfinite(features.entropies(big)).all() and np.isfinite(features.matrix_profile(big)).all() and time.time() - begun < 15


def test_the_whole_set_takes_change_quantiles_from_arrow(spark):
    rng, t = np.random.default_rng(3), dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(str(n), t + dt.timedelta(seconds=i), float(v)) for n in (1, 2, 7, 16, 90) for i, v in enumerate(np.round(rng.exponential(5, n), 1))], "k string, ts timestamp, value double")
    names = [n for n in features.efficient() if n.startswith("change_quantiles")]
    assert sorted(names) == sorted(features.FASTER[0][0])
    some = names[::7]
    tall = features.extract_tall(rows, ["k"], some)
    assert "MapInArrow" in tall._jdf.queryExecution().toString()
    got = {(r.k, r.feature): r.value for r in tall.collect()}
    for r in features.extract(rows, ["k"], some).collect():
        for n in some:
            assert got[r.k, n] == pytest.approx(r[n], abs=1e-9)
