"""Scores against labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def roc_auc(rows: DataFrame, by: tuple[str, ...] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Area under the curve by average ranks; values are counted before they are ranked.  Null with one class only."""
    counts = rows.groupBy(*by, score).agg(F.count("*").alias("c"), F.sum(F.col(y).cast("long")).alias("c1"))
    ranked = running(counts, by, score, "c").withColumn("rank", F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum("c1").cast("double").alias("n1"), F.sum("c").cast("double").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return sums.select(*by, F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc_roc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall(rows: DataFrame, by: tuple[str, ...] = (), y: str = "y", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1 (0 where a denominator is 0), and the counts of predicted and actual anomalies."""
    tp = F.count_if((F.col(y) == 1) & (F.col(predicted) == 1))
    p, a = F.count_if(F.col(predicted) == 1), F.count_if(F.col(y) == 1)
    return rows.groupBy(*by).agg(_ratio(tp, p).alias("precision"), _ratio(tp, a).alias("recall"), _ratio(2 * tp, p + a).alias("f1"), p.alias("n_predicted"), a.alias("n_actual"))


def threshold(rows: DataFrame, q: float = 0.95, y: str = "y", score: str = "score") -> DataFrame:
    """predicted: the score lies above the q-quantile of the normal rows."""
    cut = rows.agg(F.percentile(F.when(F.col(y) == 0, F.col(score)), q).alias("__cut"))
    return rows.join(F.broadcast(cut)).withColumn("predicted", (F.col(score) > F.col("__cut")).cast("int")).drop("__cut")  # one row


def report(rows: DataFrame, name: str) -> DataFrame:
    """One line for a score: counts, AUC, precision, recall, F1, rounded to three places."""
    one = precision_recall(rows).join(F.broadcast(roc_auc(rows)))  # one row each
    return one.select(F.lit(name).alias("model"), "n_predicted", "n_actual", *[F.round(c, 3).alias(c) for c in ("auc_roc", "f1", "precision", "recall")])


def lift(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(F.col("auc_roc").alias("__a")).join(F.broadcast(b.select(F.col("auc_roc").alias("__b")))).select((F.col("__a") - F.col("__b")).alias("lift"))


def benchmark(feature_sets: dict[str, DataFrame], detectors: dict[str, Callable[[DataFrame], DataFrame]], labels: DataFrame, contamination: float, key: str = "id") -> DataFrame:
    """features, algorithm and the metrics of every detector on every feature set."""
    from ..sources.io import cut
    from .detect import flag

    out = None
    for features, rows in feature_sets.items():
        for algorithm, detector in detectors.items():
            scored = flag(cut(detector(rows), "scores"), contamination).withColumnRenamed("is_outlier", "predicted").join(labels, key)
            line = report(scored, algorithm).select(F.lit(features).alias("features"), F.col("model").alias("algorithm"), "auc_roc", "f1", "precision", "recall")
            out = line if out is None else out.unionByName(line)
    return out


def pivot(results: DataFrame, feature_sets: list[str], value: str = "auc_roc") -> DataFrame:
    return results.groupBy("algorithm").pivot("features", feature_sets).agg(F.avg(value))


def anomaly_rate(rows: DataFrame, y: str = "y") -> DataFrame:
    return rows.agg((F.avg(F.col(y).cast("double")) * 100).alias("anomaly_rate"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
