"""Aligning series: joins in time, filling, windows, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE = 15


def drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def between_days(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Rows from the first day to the end of the last day (session time zone); a half-open range reaches the scan."""
    return df.where((F.col(ts) >= F.to_timestamp(F.lit(first))) & (F.col(ts) < F.to_timestamp(F.lit(last)) + F.expr("interval 1 day")))


def fill(df: DataFrame, columns: Sequence[str], ts: str = "ts", by: Sequence[str] = (), backward: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Forward fill, and with ``backward`` a backward fill of what still lacks a value; ``ties`` orders rows of one instant.

    Series are cut into days: inside a day a window fills; what crosses days is one row a day, so one long series is
    not sorted in one task.  Backward is forward in the reverse order: a frame that ends at the last row would be read anew
    for every row.
    """
    day = F.to_date(F.col(ts))
    keyed = df.withColumn("__day", day)
    inside = Window.partitionBy(*by, "__day").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*by, "__day").orderBy(F.desc(ts), *map(F.desc, ties)).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(ts, *ties) if ties else F.col(ts)
    days = keyed.groupBy(*by, "__day").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__l_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__f_{c}") for c in columns],
    )
    over = Window.partitionBy(*by).orderBy("__day")
    past, future = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    days = days.select(*by, "__day", *[F.last(f"__l_{c}", True).over(past).alias(f"__p_{c}") for c in columns], *[F.first(f"__f_{c}", True).over(future).alias(f"__n_{c}") for c in columns])
    joined = keyed.join(days.select(*[F.col(c).alias(f"__k_{c}") for c in (*by, "__day")], *[c for c in days.columns if c.startswith(("__p_", "__n_"))]), [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*by, "__day")], "left")
    values = {}
    for c in columns:
        forward = F.coalesce(F.last(c, True).over(inside), F.col(f"__p_{c}"))
        values[c] = F.coalesce(forward, F.last(c, True).over(back), F.col(f"__n_{c}")) if backward else forward
    return joined.withColumns(values).select(*df.columns)


def asof(left: DataFrame, right: DataFrame, columns: Sequence[str], ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Backward as-of join, column by column past nulls: the left join on time followed by a forward fill."""
    right = right.select(*by, ts, *columns)
    return fill(left.join(right, [*by, ts], "left"), columns, ts, by)


def interval_join(points: DataFrame, events: DataFrame, start: str = "start", end: str = "end", ts: str = "ts", bucket: int = 900) -> DataFrame:
    """Points with the events whose [start, end) holds them: an equi-join on time buckets, then the bounds."""
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket * 1_000_000)).cast("long")
    spread = events.withColumn("__b", F.explode(F.sequence(seconds(start), seconds(end))))
    return points.withColumn("__b", seconds(ts)).join(spread, "__b").where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("__b")


def bucket(ts: Column | str, width: str = "15 minutes") -> Column:
    return F.window(ts, width).start


def resample(df: DataFrame, means: Sequence[str], maxima: Sequence[str] = (), ts: str = "ts", by: Sequence[str] = (), width: str = "15 minutes") -> DataFrame:
    return df.groupBy(*by, bucket(ts, width).alias("window_id")).agg(*[F.avg(c).alias(c) for c in means], *[F.max(c).alias(c) for c in maxima])


def grid(df: DataFrame, step: str = "15 minutes", column: str = "window_id") -> DataFrame:
    """Every bucket from the first to the last, empty ones too."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(column)).join(df, column, "left")


def to_long(df: DataFrame, values: Sequence[str], ts: str = "ts", entity: str | None = "house") -> DataFrame:
    long = df.unpivot([ts], list(values), "sensor", "value")
    return long.withColumn("entity_id", F.lit(entity)) if entity is not None else long


def inner(left: DataFrame, right: DataFrame, key: str = "ts") -> DataFrame:
    """Rows of both sides at the same instant."""
    return left.join(right, key)


def roll_by_count(long: DataFrame, size: int = SIZE, ts: str = "ts", by: Sequence[str] = ("entity_id", "sensor"), stride: int | None = None) -> DataFrame:
    """Windows of ``size`` rows counted from the end of each series, one every ``stride`` rows (else side by side); short
    ones at the head are dropped.  block counts from the end, window_end is the time of a window's last row."""
    stride = stride or size
    last = Window.partitionBy(*by).orderBy(F.desc(ts))
    place = F.row_number().over(last) - 1
    numbered = long.withColumn("__at", place)
    if stride == size:
        numbered = numbered.withColumn("block", F.floor(F.col("__at") / size).cast("long"))
    else:
        # the windows that begin (seen from the end) at most size - 1 rows before a row
        first = F.greatest(F.lit(0), F.ceil((F.col("__at") - (size - 1)) / stride)).cast("long")
        upto = F.floor(F.col("__at") / stride).cast("long")
        numbered = numbered.withColumn("block", F.explode(F.when(upto >= first, F.sequence(first, upto)).otherwise(F.array().cast("array<long>"))))
    whole = Window.partitionBy(*by, "block")
    return numbered.withColumns({"__n": F.count("*").over(whole), "window_end": F.max(ts).over(whole)}).where(F.col("__n") == size).drop("__n", "__at")


def drop_last(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """All rows but the last ``n`` in time: the instant of the n-th last is found by a top-n, not by numbering all rows."""
    ends = df.select(ts).orderBy(F.desc(ts)).limit(n).agg(F.min(ts).alias("__from"), F.count("*").alias("__n"))
    return df.join(F.broadcast(ends)).where((F.col(ts) < F.col("__from")) & (F.col("__n") == n)).drop("__from", "__n") if n else df  # one row


def repair(df: DataFrame) -> DataFrame:
    """Text columns that hold numbers only become long, or double; others stay."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not text:
        return df
    able = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").try_cast(t).isNotNull() | F.col(f"`{c}`").isNull()), F.lit(False)).alias(f"{i}{t}") for i, c in enumerate(text) for t in ("long", "double")]).first()
    kinds = {c: "long" if able[f"{i}long"] else "double" for i, c in enumerate(text) if able[f"{i}double"]}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in kinds.items()}) if kinds else df


def complement(df: DataFrame, known: Sequence[str]) -> list[str]:
    """The columns of a table that are not among ``known``, in their order."""
    return [c for c in df.columns if c not in set(known)]


def with_residual(df: DataFrame, vector: str = "x", residual: str = "residual") -> DataFrame:
    """The vector with the residual as its last component."""
    return df.withColumn(vector, F.array_append(vector, F.col(residual)))


def row_error(x: Column, estimate: Column) -> Column:
    """Mean squared difference of two vectors."""
    return F.aggregate(F.zip_with(x, estimate, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(x)


def final_matrix(behaviour: DataFrame, context: DataFrame, log: DataFrame, key: str = "window_id") -> DataFrame:
    """Behaviour joined with its context by window, incomplete rows dropped, labelled by the log."""
    return label(drop_incomplete(behaviour.join(context, key)), log, key)


def roll_by_time(long: DataFrame, size: str = "15 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    return long.withColumn("window_id", F.window(ts, size, slide or size).start)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first in the order given."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def label(windows: DataFrame, log: DataFrame, key: str = "window_id", kind: str = "anomaly_type") -> DataFrame:
    """is_anomaly and the anomaly type ('normal' without one)."""
    return windows.join(log.select(key, kind), key, "left").withColumns({"is_anomaly": F.col(kind).isNotNull().cast("int"), kind: F.coalesce(kind, F.lit("normal"))})


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without a null or NaN anywhere."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    df = df.na.drop("any")
    for c in floats:
        df = df.where(~F.isnan(c))
    return df


def context_vector(df: DataFrame, numerics: Sequence[str], flags: Sequence[str], ts: str = "ts") -> DataFrame:
    """Per 15 minutes: means, flags, hour and weekday on the circle, weekend."""
    day = F.weekday("window_id")
    angle = lambda v, p: v * (2 * 3.141592653589793 / p)
    return resample(df, numerics, flags, ts).withColumns(
        {
            "hour_sin": F.sin(angle(F.hour("window_id"), 24)), "hour_cos": F.cos(angle(F.hour("window_id"), 24)),
            "dow_sin": F.sin(angle(day, 7)), "dow_cos": F.cos(angle(day, 7)), "is_weekend": (day >= 5).cast("int"),
        }
    )
