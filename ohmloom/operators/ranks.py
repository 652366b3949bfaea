"""Running sums that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import cut


def running(rows: DataFrame, by: Sequence[str], order: str, value: str, name: str = "upto", total: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` up to and with this one in ``order``
    (which tells them apart); and with ``total`` the sum over all of them.

    Rows are range-partitioned by (by, order), so one long series is spread over tasks: sums run inside a part, and the parts
    before it, one row each, give the offset.
    """
    spread = cut(rows.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranks")
    parts = spread.groupBy(*by, "__part").agg(F.sum(value).alias("__s"))
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__s").over(before), F.lit(0)), "__all": F.sum("__s").over(every)})
    keys = [*by, "__part"]
    joined = spread.join(parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__before", "__all"), [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn(name, F.sum(value).over(inside) + F.col("__before"))
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__part", "__before", "__all", *[f"__k{i}" for i in range(len(keys))])
