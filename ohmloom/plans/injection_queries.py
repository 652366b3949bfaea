"""Registered queries of the anomaly injectors, each by itself and in their packs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, inject
from ..sources.io import cut
from .registry import QUERIES, SQL, events, out, query

CHANNELS = ("V", "I", "P", "Q", "S", "FRE", "HPE", "DWE", "CWE", "WOE", "B1E")


def minutes(spark: SparkSession, d: str) -> DataFrame:
    """A gap-free minute table of eleven channels and weather made from the events' means."""
    per = events(spark, d).groupBy(F.date_trunc("minute", "ts").alias("ts")).agg(F.avg("value").alias("reading"))
    ends = per.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    full = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("ts")).join(per, "ts", "left")
    full = align.fill(full, ["reading"], backward=True)
    weather = {"wx_Clear": (F.hour("ts") % 3 == 0).cast("int"), "wx_Rain": (F.hour("ts") % 3 == 1).cast("int"), "Temp (C)": 10 + 10 * F.sin(F.hour("ts") / 4)}
    return full.withColumns({n: F.col("reading") * (1 + 0.1 * i) for i, n in enumerate(CHANNELS)} | weather).drop("reading")


_MINUTES_SQL = (
    "per as (select date_trunc('minute', ts) as ts, avg(value) as reading from events group by all), "
    "grid as (select unnest(generate_series(min(ts), max(ts), interval '1 minute')) as ts from per), "
    "filled as (select ts, last_value(reading ignore nulls) over (order by ts rows between unbounded preceding and current row) as reading from grid left join per using (ts)), "
    f"m as (select ts, {', '.join(f'reading * cast({1 + 0.1 * i!r} as double) as {c}' for i, c in enumerate(CHANNELS))}, "
    'cast(hour(ts) % 3 = 0 as int) as wx_Clear, cast(hour(ts) % 3 = 1 as int) as wx_Rain, 10 + 10 * sin(hour(ts) / 4) as "Temp (C)" from filled)'
)

#: What each injector's candidates and base statistic are, in the second engine's words.
_WORK, _REST = "isodow(ts) <= 5", "isodow(ts) >= 6"
_CANDIDATES = {
    "heating_on_warm_day": 'wx_Clear = 1 and "Temp (C)" > 15', "appliance_unusual_hours": "hour(ts) between 2 and 5", "high_usage_low_occupancy": f"hour(ts) between 10 and 15 and {_WORK}",
    "weekend_pattern_on_weekday": _WORK, "weekday_pattern_on_weekend": _REST, "night_load_spike": "hour(ts) between 1 and 4",
    "weather_mismatched_load": 'wx_Rain = 1 and abs("Temp (C)" - (select avg("Temp (C)") from m)) < 2',
}
_BASES = {
    "appliance_unusual_hours": "quantile_cont({0}, 0.9)", "weekend_pattern_on_weekday": f"avg({{0}}) filter (where {_REST})", "weekday_pattern_on_weekend": f"avg({{0}}) filter (where {_WORK})",
    "stuck_appliance_on": "quantile_cont({0}, 0.75)", "stuck_appliance_off": "0.0", "stuck_appliance": "quantile_cont({0}, 0.75)",
    "multiple_high_power_simultaneous": "quantile_cont({0}, 0.9)", "impossible_appliance_combo": "quantile_cont({0}, 0.95)",
}


def _draw_sql(salt: str, low: float, high: float) -> str:
    return f"({low!r} + {high - low!r} * (cast('0x' || substr(md5('{inject.SEED}|{salt}|' || cast(seq as varchar)), 1, 8) as bigint) / 4294967296.0))"


def _events_sql(i: inject.Injector, order: int, name: str) -> str:
    """A view of the injector's events: start, stop, seq."""
    late = f" and ts <= (select max(ts) from m) - interval '{i.minutes} minutes'" if i.minutes > 15 else ""
    rank = f"md5('{inject.SEED}|{order}|{i.name}|' || strftime(ts, '%Y-%m-%d %H:%M:%S'))"
    return (
        f"{name} as (select ts as start, ts + interval '{i.minutes} minutes' as stop, row_number() over (order by {rank}) as seq "
        f"from m where {_CANDIDATES.get(i.name, 'true')}{late} qualify seq <= {i.n})"
    )


def _changed_sql(i: inject.Injector) -> str:
    """The minutes an injector touches, and its columns as it leaves them."""
    values = []
    for k, c in enumerate(i.columns):
        u = _draw_sql(f"{i.name}|{c}", *map(float, i.draw[min(k, len(i.draw) - 1)]))
        if i.change == "set":
            base = f"max({c}) over (partition by seq)" if i.local else f"(select {_BASES[i.name].format(c)} from m)"
            values.append((c, f"{base} * {u} + {i.offset!r}", f"arg_max(v_{c}, seq)"))
        elif i.change == "add":
            values.append((c, u, f"any_value({c}) + sum(v_{c})"))
        elif i.change == "scale":
            values.append((c, u, f"any_value({c}) * product(v_{c})"))
        else:
            sign = f"case when {_draw_sql(f'sign|{i.name}', 0.0, 1.0)} < 0.5 then -1.0 else 1.0 end"
            values.append((c, f"1 + {sign} * {u} * (date_diff('second', start, ts) / 60.0) / {i.minutes - 1}", f"any_value({c}) * product(v_{c})"))
    drawn = ", ".join(f"{v} as v_{c}" for c, v, _ in values)
    folded = ", ".join(f"round({f}, 4) as {c}" for c, _, f in values)
    return (
        f"with {_MINUTES_SQL}, {_events_sql(i, 0, 'ev')}, hit as (select m.*, start, seq from m join ev on ts >= start and ts < stop), "
        f"drawn as (select *, {drawn} from hit) select ts, {folded} from drawn group by ts"
    )


def _register(i: inject.Injector, key: str) -> None:
    def changed(spark: SparkSession, d: str) -> DataFrame:
        rows = cut(minutes(spark, d), "minutes")
        found = cut(inject.pick(rows, i), "events")
        touched = align.interval_join(rows.select("ts"), found).select("ts").distinct()
        after = inject.apply(rows, i, found).join(touched, "ts", "left_semi")
        return out(after.select("ts", *[F.round(c, 4).alias(c) for c in i.columns]), "ts")

    QUERIES[key], SQL[key] = changed, _changed_sql(i)


for _number, _injector in enumerate(inject.current_pack(), 1):
    _register(_injector, f"inject_i{_number}_{_injector.name}")
for _number, _place in enumerate((1, 2, 3), 1):
    _injector = inject.first_pack()[_place]
    _register(_injector, f"inject_v{_number}_{_injector.name}")


def _log_sql(pack: list[inject.Injector]) -> str:
    """No injector changes what another's candidates are chosen by, so the log follows from the untouched table."""
    views, logs = [], []
    for order, i in enumerate(pack):
        views.append(_events_sql(i, order, f"ev{order}"))
        name = f"'{i.name}'"
        if i.change == "ramp":
            name += f" || case when {_draw_sql(f'sign|{i.name}', 0.0, 1.0)} < 0.5 then '_decrease' else '_increase' end"
        logs.append(f"select time_bucket(interval '15 minutes', start + k * interval '15 minutes') as window_id, {name} as anomaly_type, {order} as injector, seq from ev{order}, range({max(1, i.minutes // 15)}) r(k)")
    return (
        f"with {_MINUTES_SQL}, {', '.join(views)}, logged as ({' union all '.join(logs)}) "
        "select window_id, anomaly_type from logged qualify row_number() over (partition by window_id order by injector, seq) = 1"
    )


@query(_log_sql(inject.current_pack()))
def injected_log(spark, d):
    _, log = inject.run(minutes(spark, d))
    return out(log, "window_id")


@query(_log_sql(inject.first_pack()))
def first_pack_log(spark, d):
    _, log = inject.run(minutes(spark, d), inject.first_pack())
    return out(log, "window_id")


@query()
def injected_rows(spark, d):
    changed, _ = inject.run(minutes(spark, d), inject.first_pack())
    return out(changed.groupBy(align.bucket("ts").alias("window_id")).agg(F.avg("P").alias("P"), F.avg("HPE").alias("HPE")), "window_id")
