"""Column functions: times, weather regimes, seeded draws."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The regimes in the order in which a text is searched for them, and the words that mark them.
REGIME_WORDS = (("Thunderstorm", ("thunder",)), ("Snow", ("snow",)), ("Fog", ("fog",)), ("Rain", ("rain", "drizzle")), ("Cloudy", ("cloud",)), ("Clear", ("clear", "sunny")))
REGIMES = ("Clear", "Cloudy", "Fog", "Other", "Rain", "Snow", "Thunderstorm", "Unknown")
MIXED_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd")


def epoch_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("long"))


def parse_mixed(text: Column, formats: Sequence[str] = MIXED_FORMATS) -> Column:
    """Wall-clock time (no zone) of a text in any of the formats, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def localize(wall: Column, zone: str) -> Column:
    """Wall-clock time as an instant: ambiguous times become null, times in a gap move to its end.

    An instant is tried an hour on both sides; two instants with this wall clock are an ambiguity, none is a gap.
    """
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    back = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    hour = F.expr("interval 1 hour")
    ambiguous = (back(utc + hour) == wall) | (back(utc - hour) == wall)
    # in a gap the engine shifts by the gap's length; its end is the first instant of the new offset, a whole hour
    gap_end = F.date_trunc("hour", utc.cast("timestamp")).cast("timestamp_ntz")
    instant = F.when(ambiguous, None).when(back(utc) != wall, gap_end).otherwise(utc)
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), instant).cast("timestamp")


def regime(weather: Column) -> Column:
    low = F.lower(weather)
    chain = F.when(weather.isNull(), "Unknown")
    for name, words in REGIME_WORDS:
        chain = chain.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name)
    return chain.otherwise("Other")


def one_hot(value: Column, vocabulary: Sequence[str] = REGIMES, prefix: str = "wx") -> dict[str, Column]:
    return {f"{prefix}_{v}": F.coalesce((value == v).cast("int"), F.lit(0)) for v in vocabulary}


def idxmax(columns: Sequence[str], prefix: str = "wx_") -> Column:
    """The name, less its prefix, of the first column that holds the greatest value."""
    top = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return F.coalesce(*[F.when(F.col(c) == top, c.removeprefix(prefix)) for c in columns])


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def uniform(*key: Column, low: float = 0.0, high: float = 1.0, salt: str = "") -> Column:
    """A draw from [low, high) that depends on the key alone: the same in every run, engine and partitioning."""
    text = F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in key])
    return F.lit(float(low)) + (high - low) * (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0))


def rank_key(*key: Column, salt: str = "") -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in key]))
