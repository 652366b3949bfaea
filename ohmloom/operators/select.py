"""Imputation, scaling and hypothesis-test selection of features, on the tall form (id, feature, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import running

ALPHA = 0.05


def impute(rows: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Per feature: +inf to the greatest finite value, -inf to the least, missing to the median, nothing finite to 0."""
    v = F.col(value)
    finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    stats = rows.groupBy(feature).agg(F.max(finite).alias("__hi"), F.min(finite).alias("__lo"), F.percentile(finite, 0.5).alias("__mid"))
    fixed = F.when(v == float("inf"), F.col("__hi")).when(v == float("-inf"), F.col("__lo")).when(v.isNull() | F.isnan(v), F.col("__mid")).otherwise(v)
    return rows.join(stats, feature).withColumn(value, F.coalesce(fixed, F.lit(0.0))).select(*rows.columns)


def min_max(rows: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """(x - min) / (max - min) per feature; a constant becomes 0."""
    stats = rows.groupBy(feature).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    return rows.join(stats, feature).withColumn(value, scaled).select(*rows.columns)


def normal_tail(z: Column) -> Column:
    """erfc(|z| / sqrt 2): twice the upper tail, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def mann_whitney(rows: DataFrame, target: str = "y", feature: str = "feature", value: str = "value") -> DataFrame:
    """feature, z, p: two-sided, with tie and continuity correction.  Values are counted before they are ranked."""
    counts = rows.groupBy(feature, value).agg(F.count("*").alias("c"), F.sum(F.col(target).cast("long")).alias("c1"))
    ranked = running(counts, [feature], value, "c").withColumn("rank", F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)
    per = ranked.groupBy(feature).agg(
        F.sum("c").cast("double").alias("n"), F.sum("c1").cast("double").alias("n1"), F.sum(F.col("rank") * F.col("c1")).alias("r1"),
        F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("ties"),
    )
    n0 = F.col("n") - F.col("n1")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * n0 / 2
    sigma = F.sqrt(F.col("n1") * n0 / 12 * (F.col("n") + 1 - F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1))))
    z = F.try_divide(F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)), sigma)
    return per.select(feature, z.alias("z")).withColumn("p", F.coalesce(normal_tail(F.col("z")), F.lit(1.0)))


def fisher(rows: DataFrame, target: str = "y", feature: str = "feature", value: str = "value") -> DataFrame:
    """feature, p of Fisher's exact test for features of two values."""
    cells = rows.join(rows.groupBy(feature).agg(F.max(value).alias("__hi")), feature).groupBy(feature).agg(
        F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("n1"), F.count_if(F.col(value) == F.col("__hi")).alias("k"), F.sum(F.when(F.col(value) == F.col("__hi"), F.col(target)).otherwise(0).cast("long")).alias("a")
    )

    def work(batches):
        import pyarrow as pa

        ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        for batch in batches:
            names, ps = [], []
            for name, n, n1, k, a in zip(*(batch.column(i).to_pylist() for i in range(5))):
                chance = [ln(k, x) + ln(n - k, n1 - x) - ln(n, n1) for x in range(max(0, n1 - (n - k)), min(k, n1) + 1)]
                seen = ln(k, a) + ln(n - k, n1 - a) - ln(n, n1)
                names.append(name)
                ps.append(min(1.0, sum(math.exp(c) for c in chance if c <= seen + 1e-7)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ps, pa.float64())], [feature, "p"])

    return cells.mapInArrow(work, f"{feature} string, p double")


def select(rows: DataFrame, target: str = "y", alpha: float = ALPHA, feature: str = "feature", value: str = "value") -> DataFrame:
    """feature, p, kept: features relevant to a binary target at false discovery rate ``alpha`` (Benjamini-Yekutieli)."""
    kinds = rows.groupBy(feature).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    two = rows.join(kinds, feature).groupBy(feature).agg(F.bool_and((F.col(value) == F.col("lo")) | (F.col(value) == F.col("hi"))).alias("binary"), F.max(F.col("hi") > F.col("lo")).alias("varies"))
    varying = two.where("varies")
    real = mann_whitney(rows.join(varying.where("not binary").select(feature), feature, "left_semi"), target, feature, value).select(feature, "p")
    binary = fisher(rows.join(varying.where("binary").select(feature), feature, "left_semi"), target, feature, value)
    return benjamini_yekutieli(real.unionByName(binary), alpha)


def benjamini_yekutieli(p_values: DataFrame, alpha: float = ALPHA, p: str = "p") -> DataFrame:
    """One row for each hypothesis (thousands, whatever the data): kept are all up to the last that passes."""
    every = Window.partitionBy()
    ranked = p_values.withColumn("i", F.row_number().over(Window.orderBy(p))).withColumn("m", F.count("*").over(every))
    harmonic = F.sum(1 / F.col("i")).over(every)
    passed = ranked.withColumn("ok", F.col(p) <= F.col("i") * alpha / (F.col("m") * harmonic))
    return passed.withColumn("kept", F.col("i") <= F.coalesce(F.max(F.when(F.col("ok"), F.col("i"))).over(every), F.lit(0))).drop("i", "m", "ok")
