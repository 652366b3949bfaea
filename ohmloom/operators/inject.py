"""Synthetic anomalies: each injector is a description; one operator applies any of them to a minute table.

An injector picks ``n`` start rows among its candidates by a seeded hash, changes [start, start + minutes) and logs every
window that starts there.  Statistics are taken from the frame as the injector finds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import rank_key, uniform
from ..sources.io import cut
from .align import first_by, interval_join

SEED = 42


@dataclass(frozen=True)
class Injector:
    name: str
    n: int
    minutes: int
    columns: tuple[str, ...]
    change: str  # set, add, scale, ramp
    draw: tuple[tuple[float, float], ...] = ((1.0, 1.0),)  # one range, or one for each column
    base: Callable[[DataFrame, str], Column] | None = None  # an aggregate of the frame, for "set"
    offset: float = 0.0
    local: bool = False  # the base is an aggregate over the event's own rows
    candidates: Callable[[DataFrame], Column] | None = None
    needs: tuple[str, ...] = field(default=())


def _quantile(q: float):
    return lambda df, c: F.percentile(c, q)





def _weekday(df: DataFrame) -> Column:
    return F.weekday("ts") < 5


def _weekend(df: DataFrame) -> Column:
    return F.weekday("ts") >= 5


def _hours(lo: int, hi: int):
    return lambda df: F.hour("ts").between(lo, hi)


def current_pack() -> list[Injector]:
    """Thirteen injectors in their order; 830 log rows before windows are united."""
    day_mean = lambda df, c: F.avg(F.when(F.weekday("ts") < 5, F.col(c)))
    end_mean = lambda df, c: F.avg(F.when(F.weekday("ts") >= 5, F.col(c)))
    return [
        Injector("heating_on_warm_day", 65, 15, ("HPE",), "set", ((3, 5),), lambda df, c: F.max(c), 500, True, lambda df: (F.col("wx_Clear") == 1) & (F.col("Temp (C)") > 15)),
        Injector("appliance_unusual_hours", 80, 15, ("WOE",), "set", ((1.5, 3),), _quantile(0.9), candidates=_hours(2, 5)),
        Injector("high_usage_low_occupancy", 80, 15, ("P",), "add", ((700, 1400),), candidates=lambda df: F.hour("ts").between(10, 15) & (F.weekday("ts") < 5)),
        Injector("weekend_pattern_on_weekday", 65, 15, ("CWE",), "set", ((1.5, 2.5),), end_mean, candidates=_weekday),
        Injector("weekday_pattern_on_weekend", 65, 15, ("CWE",), "set", ((1.5, 2.5),), day_mean, candidates=_weekend),
        Injector("stuck_appliance_on", 16, 90, ("DWE",), "set", base=_quantile(0.75)),
        Injector("stuck_appliance_off", 16, 90, ("HPE",), "set", base=lambda df, c: F.max(F.lit(0.0))),
        Injector("gradual_drift", 20, 60, ("B1E",), "ramp", ((0.8, 1.5),)),
        Injector("sustained_overload", 16, 60, ("P",), "add", ((1000, 1800),)),
        Injector("multiple_high_power_simultaneous", 40, 15, ("HPE", "DWE", "CWE"), "set", ((1.2, 1.8),) * 3, _quantile(0.9)),
        Injector("impossible_appliance_combo", 33, 15, ("HPE", "WOE"), "set", ((1.3, 2),) * 2, _quantile(0.95)),
        Injector("power_spike", 40, 15, ("P",), "add", ((900, 1700),)),
        Injector("sensor_glitch", 26, 15, ("V", "I"), "scale", ((0.5, 1.8), (0.3, 2.5))),
    ]


def first_pack() -> list[Injector]:
    """The five earlier injectors; 95 log rows."""
    now = {i.name: i for i in current_pack()}
    warm, weekend = now["heating_on_warm_day"], now["weekend_pattern_on_weekday"]
    from dataclasses import replace

    return [
        replace(warm, n=15),
        Injector("night_load_spike", 15, 15, ("P",), "add", ((800, 1500),), candidates=_hours(1, 4)),
        Injector("stuck_appliance", 10, 60, ("DWE",), "set", base=_quantile(0.75)),
        Injector("weather_mismatched_load", 15, 15, ("P",), "add", ((600, 1200),), candidates=lambda df: (F.col("wx_Rain") == 1) & (F.abs(F.col("Temp (C)") - df.agg(F.avg("Temp (C)")).first()[0]) < 2)),
        replace(weekend, n=10),
    ]


def pick(df: DataFrame, injector: Injector, seed: int = SEED, order: int = 0) -> DataFrame:
    """start, end, seq of at most n events: the candidates of the least seeded hashes."""
    rows = df.where(injector.candidates(df)) if injector.candidates else df
    if injector.minutes > 15:  # long events keep clear of the last rows: as many minutes as they last
        last = df.agg(F.max("ts").alias("__last"))
        rows = rows.join(F.broadcast(last)).where(F.col("ts") <= F.col("__last") - F.expr(f"interval {injector.minutes} minutes"))
    chosen = rows.select("ts").orderBy(rank_key(F.col("ts"), salt=f"{seed}|{order}|{injector.name}")).limit(injector.n)
    seq = F.row_number().over(Window.orderBy(rank_key(F.col("ts"), salt=f"{seed}|{order}|{injector.name}")))  # at most n rows
    return chosen.select(F.col("ts").alias("start"), (F.col("ts") + F.expr(f"interval {injector.minutes} minutes")).alias("end"), seq.alias("seq"))


def log_rows(events: DataFrame, injector: Injector, order: int = 0, every_touched: bool = False, seed: int = SEED) -> DataFrame:
    """window_id, anomaly_type and the order of logging; with ``every_touched`` also the window an event spills into."""
    steps = F.sequence(F.lit(0), F.lit(max(0, injector.minutes // 15 - 1)))
    logged = events.select(F.explode(F.transform(steps, lambda i: F.col("start") + F.make_dt_interval(mins=i * 15))).alias("t"), "start", "end", "seq")
    if every_touched:
        logged = logged.union(events.select(F.col("end") - F.expr("interval 1 second"), "start", "end", "seq"))
    name = F.lit(injector.name)
    if injector.change == "ramp":
        name = F.concat(name, F.when(_sign("seq", injector, seed) > 0, "_increase").otherwise("_decrease"))
    return logged.select(F.window("t", "15 minutes").start.alias("window_id"), name.alias("anomaly_type"), F.lit(order).alias("injector"), "seq")


def _sign(seq: str, injector: Injector, seed: int) -> Column:
    return F.when(uniform(F.col(seq), salt=f"{seed}|sign|{injector.name}") < 0.5, -1.0).otherwise(1.0)


def apply(df: DataFrame, injector: Injector, events: DataFrame, seed: int = SEED) -> DataFrame:
    """The frame with the injector's columns changed where its events lie; overlapping events fold in their order."""
    hits = interval_join(df.select("ts", *injector.columns), events)
    stats = None
    if injector.base is not None:
        aggregates = [injector.base(df, c).alias(f"__s_{c}") for c in injector.columns]
        stats = hits.groupBy("seq").agg(*aggregates) if injector.local else df.agg(*aggregates)
        hits = hits.join(stats, "seq") if injector.local else hits.join(F.broadcast(stats))  # one row, or one for each event
    folded = []
    for i, c in enumerate(injector.columns):
        low, high = injector.draw[min(i, len(injector.draw) - 1)]
        u = uniform(F.col("seq"), low=low, high=high, salt=f"{seed}|{injector.name}|{c}")
        if injector.change == "set":
            folded.append(F.max_by(F.col(f"__s_{c}") * u + F.lit(float(injector.offset)), "seq").alias(f"__v_{c}"))
        elif injector.change == "add":
            folded.append(F.sum(u).alias(f"__v_{c}"))
        else:
            factor = u
            if injector.change == "ramp":
                minute = (F.unix_timestamp("ts") - F.unix_timestamp("start")) / 60
                factor = 1 + _sign("seq", injector, seed) * u * minute / (injector.minutes - 1)
            # products over overlapping events
            folded.append(F.aggregate(F.collect_list(factor), F.lit(1.0), lambda a, x: a * x).alias(f"__v_{c}"))
    changes = hits.groupBy("ts").agg(*folded)
    new = {}
    for c in injector.columns:
        v = F.col(f"__v_{c}")
        value = v if injector.change == "set" else F.col(c) + v if injector.change == "add" else F.col(c) * v
        new[c] = F.when(v.isNotNull(), value).otherwise(F.col(c))
    return df.join(changes, "ts", "left").withColumns(new).select(*df.columns)


def run(df: DataFrame, pack: Sequence[Injector] | None = None, seed: int = SEED, every_touched: bool = False) -> tuple[DataFrame, DataFrame]:
    """The changed frame and the log, one row for each window: the first injector and event there name it."""
    log, df = None, cut(df, "inject")
    for order, injector in enumerate(pack or current_pack()):
        events = cut(pick(df, injector, seed, order), "events")
        rows = log_rows(events, injector, order, every_touched, seed)
        log = rows if log is None else log.unionByName(rows)
        # every step reads its predecessor several times
        df = cut(apply(df, injector, events, seed), "inject")
    return df, first_by(log, ["window_id"], ["injector", "seq"]).select("window_id", "anomaly_type")
