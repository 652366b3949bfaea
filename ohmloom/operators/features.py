"""Features of windows.  One grouping by window turns each series piece into a time-ordered array beside its plain
aggregates; every calculator is an expression over these columns (no further shuffle), linear in the window's length, and
those that need a recursion, a transform or a matrix run in one Arrow pass, all windows of one length at a time.

``MINIMAL`` needs no array at all.  ``efficient()`` maps a name to a function of a ``Piece``; ``FAMILIES`` lists the Arrow
calculators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut

D = lambda v: F.lit(float(v))
_len = lambda x: F.size(x).cast("double")
#: Calculators planned together; Catalyst's time grows faster than their number.
TOGETHER = 40


@dataclass(frozen=True)
class Piece:
    """The columns of one window: its values in time order, the same sorted, and aggregates.  A lambda that needs an
    aggregate reads its column; computed inside, it would be computed again for every element."""

    x: Column
    s: Column
    n: Column
    mean: Column
    var: Column
    std: Column
    lo: Column
    hi: Column
    total: Column
    energy: Column
    size: Column  # sum of absolute values
    distinct: Column


_STATS = ("n", "mean", "var", "std", "lo", "hi", "total", "energy", "size")


def _piece() -> Piece:
    return Piece(*(F.col(f"__{c}") for c in ("x", "s", *_STATS, "distinct")))


def _sum(x: Column) -> Column:
    return F.aggregate(x, D(0), lambda a, v: a + v)


def _avg(x: Column) -> Column:
    return F.try_divide(_sum(x), _len(x))


def _var(x: Column) -> Column:
    """Population variance of an array by Welford's recursion."""
    start = F.struct(D(0).alias("n"), D(0).alias("m"), D(0).alias("q"))

    def step(a: Column, v: Column) -> Column:
        mean = a["m"] + (v - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("m"), (a["q"] + (v - a["m"]) * (v - mean)).alias("q"))

    return F.aggregate(x, start, step, lambda a: F.try_divide(a["q"], a["n"]))


def _upto(first: Column | int, last: Column) -> Column:
    """first, first + 1, ... last; empty if last is smaller."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _last(w: Piece) -> Column:
    return F.size(w.x) - 1


def _quantile(w: Piece, q: float) -> Column:
    at = F.round((w.n - 1) * q, 9)  # 0.8 * 15 is a little over 12
    lo = F.floor(at).cast("int")
    low = F.get(w.s, lo)
    return low + (F.coalesce(F.get(w.s, lo + 1), low) - low) * (at - lo)


def _diff(w: Piece) -> Column:
    return F.transform(_upto(1, _last(w)), lambda i: F.get(w.x, i) - F.get(w.x, i - 1))


def _count(x: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(x, test)).cast("double")


def _equal(x: Column, value: int) -> Column:
    return _count(x, lambda v: v == value)


def _share(w: Piece, test: Callable[[Column], Column]) -> Column:
    return _count(w.x, test) / w.n


def _moment(w: Piece, k: int) -> Column:
    return _sum(F.transform(w.x, lambda v: F.pow(v - w.mean, D(k)))) / w.n


def _skew(w: Piece) -> Column:
    return F.when(w.n < 3, None).when(w.var <= 0, 0.0).otherwise(F.sqrt(w.n * (w.n - 1)) / (w.n - 2) * _moment(w, 3) / F.pow(w.var, D(1.5)))


def _kurt(w: Piece) -> Column:
    n = w.n
    return F.when(n < 4, None).when(w.var <= 0, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (_moment(w, 4) / (w.var * w.var) - 3) + 6))


def _at(w: Piece, value: Column, last: bool) -> Column:
    found = F.array_position(F.reverse(w.x) if last else w.x, value).cast("double")
    return (1 - (found - 1) / w.n) if last else (found - 1) / w.n


def _run(x: Column, test: Callable[[Column], Column]) -> Column:
    start = F.struct(D(0).alias("now"), D(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        longer = F.struct((a["now"] + 1).alias("now"), F.greatest(a["best"], a["now"] + 1).alias("best"))
        return F.when(test(v), longer).otherwise(F.struct(D(0).alias("now"), a["best"].alias("best")))

    return F.aggregate(x, start, step, lambda a: a["best"])


def _lagged(w: Piece, lag: int, value: Callable[[Column, Column, Column], Column], width: int = 2) -> Column:
    """Mean of value(x[i], x[i+lag], x[i+2 lag]) over all i that have them; null where none has."""
    last = _last(w) - (width - 1) * lag
    third = (lambda i: F.get(w.x, i + 2 * lag)) if width == 3 else (lambda i: F.lit(None))
    terms = F.transform(_upto(0, last), lambda i: value(F.get(w.x, i), F.get(w.x, i + lag), third(i)))
    return F.when(last >= 0, _sum(terms) / (last + 1))


def _autocorrelation(w: Piece, lag: int) -> Column:
    return F.when(w.var > 0, _lagged(w, lag, lambda a, b, _: (a - w.mean) * (b - w.mean)) / w.var)


def _fft(w: Piece, k: int, part: str) -> Column:
    wave, sign = (F.cos, 1.0) if part == "real" else (F.sin, -1.0)
    return _sum(F.transform(w.x, lambda v, i: v * sign * wave(i * (2 * math.pi * k) / w.n)))


def _trend(y: Column, n: Column, what: str) -> Column:
    """Least squares of an array of length n on 0, 1, ...; null under two points."""
    total, cross = _sum(y), _sum(F.transform(y, lambda v, i: v * i))
    centred = cross - total * (n - 1) / 2
    slope = centred / (n * (n * n - 1) / 12)
    if what == "slope":
        out = slope
    elif what == "intercept":
        out = total / n - slope * (n - 1) / 2
    else:
        spread = _var(y) * n
        if what == "rvalue":
            out = F.when(spread > 0, centred / F.sqrt(spread * n * (n * n - 1) / 12)).otherwise(0.0)
        else:
            rest = F.greatest(spread - slope * centred, D(0))
            out = F.when(n > 2, F.sqrt(rest / F.nullif(n - 2, D(0)) / (n * (n * n - 1) / 12))).otherwise(0.0)
    return F.when(n > 1, out)


def _chunks(w: Piece, size: int, agg: Callable[[Column], Column]) -> Column:
    starts = F.sequence(F.lit(0), F.floor(_last(w) / size).cast("int"))
    return F.transform(starts, lambda i: agg(F.slice(w.x, i * size + 1, size)))


def _repeated(w: Piece) -> Column:
    """Values that occur more than once, each once: where a run of equal sorted values has its second."""
    equal = lambda i: F.get(w.s, i) == F.get(w.s, i - 1)
    second = F.filter(_upto(1, _last(w)), lambda i: equal(i) & F.when(i >= 2, ~equal(i - 1)).otherwise(True))
    return F.transform(second, lambda i: F.get(w.s, i))


def _among_equals(w: Piece) -> Column:
    """All values that have an equal."""
    same = lambda i, j: F.coalesce(F.get(w.s, i) == F.get(w.s, j), F.lit(False))
    return F.transform(F.filter(_upto(0, _last(w)), lambda i: same(i, i + 1) | F.when(i > 0, same(i, i - 1)).otherwise(False)), lambda i: F.get(w.s, i))


def _entropy(shares: Column) -> Column:
    return -_sum(F.transform(F.filter(shares, lambda p: p > 0), lambda p: p * F.ln(p)))


def _binned_entropy(w: Piece, bins: int) -> Column:
    width = (w.hi - w.lo) / bins
    which = F.transform(w.x, lambda v: F.when(width <= 0, F.lit(0)).otherwise(F.least(F.floor((v - w.lo) / width).cast("int"), F.lit(bins - 1))))
    counts = [_equal(which, k) / w.n for k in range(bins)]
    return _entropy(F.array(*counts))


def _peaks(w: Piece, support: int) -> Column:
    beside = [k for k in range(-support, support + 1) if k]

    def higher(i: Column) -> Column:
        if support <= 3:
            out = F.lit(True)
            for k in beside:
                out = out & (F.get(w.x, i) > F.get(w.x, i + k))
            return out
        return F.forall(F.array(*map(F.lit, beside)), lambda k: F.get(w.x, i) > F.get(w.x, i + k))

    return _count(_upto(support, _last(w) - support), higher)


def _mass(w: Piece, q: float) -> Column:
    start = F.struct(D(0).alias("sum"), D(0).alias("i"), F.lit(None).cast("double").alias("at"))

    def step(a: Column, v: Column) -> Column:
        held, i = a["sum"] + F.abs(v), a["i"] + 1
        return F.struct(held.alias("sum"), i.alias("i"), F.coalesce(a["at"], F.when(held >= q * w.size, i)).alias("at"))

    return F.when(w.size > 0, F.aggregate(w.x, start, step, lambda a: F.coalesce(a["at"], a["i"])) / w.n)


def _change(w: Piece, low: float, high: float, absolute: bool, agg: str) -> Column:
    a, b = _quantile(w, low), _quantile(w, high)
    inside = lambda v: (v >= a) & (v <= b)
    at = F.filter(_upto(1, _last(w)), lambda i: inside(F.get(w.x, i)) & inside(F.get(w.x, i - 1)))
    steps = F.transform(at, lambda i: F.abs(F.get(w.x, i) - F.get(w.x, i - 1)) if absolute else F.get(w.x, i) - F.get(w.x, i - 1))
    return F.coalesce(_avg(steps) if agg == "mean" else _var(steps), D(0))


def _energy_chunk(w: Piece, s: int, segments: int = 10) -> Column:
    # the first n mod segments pieces are longer by one
    n, base, extra = F.size(w.x), F.floor(F.size(w.x) / segments).cast("int"), F.size(w.x) % segments
    piece = F.slice(w.x, base * s + F.least(F.lit(s), extra) + 1, base + F.when(F.lit(s) < extra, 1).otherwise(0))
    return F.try_divide(_sum(F.transform(piece, lambda v: v * v)), w.energy)


def _benford(w: Piece) -> Column:
    digit = F.transform(w.x, lambda v: F.substring(F.regexp_replace(F.format_string("%.15e", F.abs(v)), "[^0-9]", ""), 1, 1).cast("int"))
    share = [_equal(digit, d) / w.n for d in range(1, 10)]
    law = [math.log10(1 + 1 / d) for d in range(1, 10)]
    mean = sum(share[1:], share[0]) / 9
    spread = sum((p * p for p in share[1:]), share[0] * share[0]) / 9 - mean * mean
    cov = sum((p * v for p, v in zip(share[1:], law[1:])), share[0] * law[0]) / 9 - mean / 9
    return F.when(spread > 1e-12, cov / F.sqrt(spread * (sum(v * v for v in law) / 9 - 1 / 81)))


MINIMAL: dict[str, Callable[[Piece], Column]] = {
    "sum_values": lambda w: w.total,
    "median": lambda w: _quantile(w, 0.5),
    "mean": lambda w: w.mean,
    "length": lambda w: w.n,
    "standard_deviation": lambda w: w.std,
    "variance": lambda w: w.var,
    "root_mean_square": lambda w: F.sqrt(w.energy / w.n),
    "maximum": lambda w: w.hi,
    "absolute_maximum": lambda w: F.greatest(F.abs(w.lo), F.abs(w.hi)),
    "minimum": lambda w: w.lo,
}


def efficient() -> dict[str, Callable[[Piece], Column]]:
    """All calculators that are expressions, by name; parameters follow the calculator's name."""
    f = dict(MINIMAL)
    f |= {f"quantile__q_{q}": (lambda w, q=q: _quantile(w, q)) for q in (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)}
    f |= {
        "abs_energy": lambda w: w.energy,
        "variation_coefficient": lambda w: F.when(w.mean != 0, F.try_divide(w.std, w.mean)),
        "skewness": _skew,
        "kurtosis": _kurt,
        "variance_larger_than_standard_deviation": lambda w: (w.var > w.std).cast("double"),
        "has_duplicate": lambda w: (w.distinct < w.n).cast("double"),
        "has_duplicate_max": lambda w: (_count(w.x, lambda v: v == w.hi) > 1).cast("double"),
        "has_duplicate_min": lambda w: (_count(w.x, lambda v: v == w.lo) > 1).cast("double"),
        "sum_of_reoccurring_values": lambda w: _sum(_repeated(w)),
        "sum_of_reoccurring_data_points": lambda w: _sum(_among_equals(w)),
        "percentage_of_reoccurring_values_to_all_values": lambda w: _len(_repeated(w)) / w.distinct,
        "percentage_of_reoccurring_datapoints_to_all_datapoints": lambda w: _len(_among_equals(w)) / w.n,
        "ratio_value_number_to_time_series_length": lambda w: w.distinct / w.n,
        "count_above_mean": lambda w: _count(w.x, lambda v: v > w.mean),
        "count_below_mean": lambda w: _count(w.x, lambda v: v < w.mean),
        "count_above__t_0": lambda w: _share(w, lambda v: v >= 0),
        "count_below__t_0": lambda w: _share(w, lambda v: v <= 0),
        "first_location_of_maximum": lambda w: _at(w, w.hi, False),
        "last_location_of_maximum": lambda w: _at(w, w.hi, True),
        "first_location_of_minimum": lambda w: _at(w, w.lo, False),
        "last_location_of_minimum": lambda w: _at(w, w.lo, True),
        "mean_change": lambda w: F.try_divide(F.get(w.x, _last(w)) - F.get(w.x, F.lit(0)), w.n - 1),
        "mean_abs_change": lambda w: _avg(F.transform(_diff(w), lambda v: F.abs(v))),
        "absolute_sum_of_changes": lambda w: _sum(F.transform(_diff(w), lambda v: F.abs(v))),
        "mean_second_derivative_central": lambda w: F.when(w.n > 2, F.try_divide(F.get(w.x, _last(w)) - F.get(w.x, _last(w) - 1) - F.get(w.x, F.lit(1)) + F.get(w.x, F.lit(0)), 2 * (w.n - 2))),
        "cid_ce__normalize_False": lambda w: F.sqrt(_sum(F.transform(_diff(w), lambda v: v * v))),
        "cid_ce__normalize_True": lambda w: F.when(w.var > 0, F.sqrt(_sum(F.transform(_diff(w), lambda v: v * v)) / w.var)).otherwise(0.0),
        "longest_strike_above_mean": lambda w: _run(w.x, lambda v: v > w.mean),
        "longest_strike_below_mean": lambda w: _run(w.x, lambda v: v < w.mean),
        "binned_entropy__max_bins_10": lambda w: _binned_entropy(w, 10),
        "benford_correlation": _benford,
    }
    f |= {f"linear_trend__attr_{a}": (lambda w, a=a: _trend(w.x, w.n, a)) for a in ("slope", "intercept", "rvalue", "stderr")}
    f |= {f"large_standard_deviation__r_{r / 100}": (lambda w, r=r / 100: (w.std > r * (w.hi - w.lo)).cast("double")) for r in range(5, 100, 5)}
    f |= {f"symmetry_looking__r_{r / 100}": (lambda w, r=r / 100: (F.abs(w.mean - _quantile(w, 0.5)) < r * (w.hi - w.lo)).cast("double")) for r in range(0, 100, 5)}
    f |= {f"value_count__value_{v}": (lambda w, v=v: _count(w.x, lambda u: u == v)) for v in (0, 1, -1)}
    f |= {f"range_count__max_{hi}__min_{lo}": (lambda w, lo=lo, hi=hi: _count(w.x, lambda v: (v >= lo) & (v < hi))) for lo, hi in ((-1, 1), (-1e12, 0), (0, 1e12))}
    f |= {f"ratio_beyond_r_sigma__r_{r}": (lambda w, r=r: _share(w, lambda v: F.abs(v - w.mean) > r * w.std)) for r in (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)}
    f |= {f"c3__lag_{k}": (lambda w, k=k: F.coalesce(_lagged(w, k, lambda a, b, c: a * b * c, 3), D(0))) for k in (1, 2, 3)}
    f |= {f"time_reversal_asymmetry_statistic__lag_{k}": (lambda w, k=k: F.coalesce(_lagged(w, k, lambda a, b, c: c * c * b - b * a * a, 3), D(0))) for k in (1, 2, 3)}
    f |= {f"autocorrelation__lag_{k}": (lambda w, k=k: _autocorrelation(w, k)) for k in range(10)}
    f |= {f"number_crossing_m__m_{m}": (lambda w, m=m: _count(_upto(1, _last(w)), lambda i: (F.get(w.x, i) > m) != (F.get(w.x, i - 1) > m))) for m in (-1, 0, 1)}
    f |= {f"number_peaks__n_{n}": (lambda w, n=n: _peaks(w, n)) for n in (1, 3, 5, 10, 50)}
    f |= {f"index_mass_quantile__q_{q / 10}": (lambda w, q=q / 10: _mass(w, q)) for q in range(1, 10)}
    f |= {f"energy_ratio_by_chunks__num_segments_10__segment_focus_{s}": (lambda w, s=s: _energy_chunk(w, s)) for s in range(10)}
    f |= {f"mean_n_absolute_max__number_of_maxima_{n}": (lambda w, n=n: F.when(w.n >= n, _sum(F.slice(F.sort_array(F.transform(w.x, lambda v: F.abs(v)), False), 1, n)) / n)) for n in (3, 7)}
    has = lambda w, k: F.floor(w.n / 2) >= k
    f |= {f"fft_coefficient__attr_{p}__coeff_{k}": (lambda w, p=p, k=k: F.when(has(w, k), _fft(w, k, p))) for p in ("real", "imag") for k in range(8)}
    f |= {f"fft_coefficient__attr_abs__coeff_{k}": (lambda w, k=k: F.when(has(w, k), F.hypot(_fft(w, k, "real"), _fft(w, k, "imag")))) for k in range(8)}
    f |= {f"fft_coefficient__attr_angle__coeff_{k}": (lambda w, k=k: F.when(has(w, k), F.degrees(F.atan2(_fft(w, k, "imag"), _fft(w, k, "real"))))) for k in range(8)}
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):
        for high in (0.2, 0.4, 0.6, 0.8, 1.0):
            for absolute in (False, True):
                for agg in ("mean", "var"):
                    if low < high:
                        f[f"change_quantiles__f_agg_{agg}__isabs_{absolute}__qh_{high}__ql_{low}"] = lambda w, a=(low, high, absolute, agg): _change(w, *a)
    for size in (5, 10, 50):
        for name, agg in (("max", F.array_max), ("min", F.array_min), ("mean", _avg), ("var", _var)):
            for attr in ("slope", "intercept", "rvalue", "stderr"):
                f[f"agg_linear_trend__attr_{attr}__chunk_len_{size}__f_agg_{name}"] = lambda w, s=size, a=agg, t=attr: _trend(_chunks(w, s, a), F.ceil(w.n / s).cast("double"), t)
    return f


def arrays(long: DataFrame, by: Iterable[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """by..., the values of each group in time order and sorted, and their aggregates.  A group is one window, bounded by
    its length.  Mean and variance are taken in time order: partial sums would put a value that equals the mean on either
    side of it by how the rows were dealt out."""
    v = F.col(value).cast("double")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ts), v.alias("v"))))
    stats = {"n": F.count(v).cast("double"), "lo": F.min(v), "hi": F.max(v), "total": F.sum(v), "energy": F.sum(v * v), "size": F.sum(F.abs(v))}
    grouped = long.where(F.col(value).isNotNull()).groupBy(*by).agg(ordered.alias("__o"), *[c.alias(f"__{n}") for n, c in stats.items()])
    named = grouped.select(*by, F.transform("__o", lambda s: s["v"]).alias("__x"), *[f"__{n}" for n in stats])
    # exploded, so that they are columns for the lambdas and not computed again for every element
    named = named.withColumn("__m", F.explode(F.array(F.struct(_avg(F.col("__x")).alias("mean"), _var(F.col("__x")).alias("var")))))
    named = named.select(*by, "__x", *[{"mean": F.col("__m.mean"), "var": F.col("__m.var"), "std": F.sqrt("__m.var")}.get(n, F.col(f"__{n}")).alias(f"__{n}") for n in _STATS])
    named = named.withColumn("__s", F.array_sort("__x"))
    return named.withColumn("__distinct", F.size(F.array_distinct("__s")).cast("double"))


def minimal(long: DataFrame, by: Iterable[str], value: str = "value") -> DataFrame:
    """The minimal set by plain aggregates: partial sums before the shuffle, no array."""
    v = F.col(value).cast("double")
    return long.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.sum(v).alias("sum_values"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.count(v).cast("double").alias("length"), F.stddev_pop(v).alias("standard_deviation"),
        F.var_pop(v).alias("variance"), F.sqrt(F.avg(v * v)).alias("root_mean_square"), F.max(v).alias("maximum"), F.max(F.abs(v)).alias("absolute_maximum"), F.min(v).alias("minimum"),
    )


def extract(long: DataFrame, by: Iterable[str], names: Iterable[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """One row for each group, one column for each calculator (all expressions unless ``names`` says which)."""
    known, w = efficient(), _piece()
    chosen = list(names) if names is not None else list(known)
    return arrays(long, by, ts, value).select(*by, *[known[n](w).alias(n) for n in chosen])


def extract_tall(long: DataFrame, by: list[str], names: Iterable[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """by..., feature, value of all calculators, expressions and Arrow families: the windows are written once and read by
    parts of about ``TOGETHER`` calculators, as a plan of hundreds takes longer to make than to run."""
    known, w = efficient(), _piece()
    chosen = list(names) if names is not None else [*known, *arrow_names()]
    pieces = cut(arrays(long, by, ts, value), "pieces")
    faster = {n for names, _ in FASTER for n in names}
    mine = [n for n in chosen if n in known and n not in faster]
    out = None
    for lo in range(0, len(mine), TOGETHER):
        some = tall(pieces.select(*by, *[known[n](w).alias(n) for n in mine[lo : lo + TOGETHER]]), by)
        out = some if out is None else out.unionByName(some)
    rest = [n for n in chosen if n not in known or n in faster]
    if rest:
        some = tall(_arrow(pieces, by, rest), by)
        out = some if out is None else out.unionByName(some)
    return out


def pacf(x: np.ndarray, lags: int = 9) -> list[float]:
    """Durbin-Levinson on the autocovariances over n - k; lags from half the length on have none."""
    n = len(x)
    most = min(lags, n // 2 - 1)
    if n < 2 or most < 1:
        return [math.nan] * (lags + 1)
    c = x - x.mean()
    r = [float((c[: n - k] * c[k:]).sum() / (n - k)) for k in range(most + 1)]
    if r[0] <= 0:
        return [1.0] + [math.nan] * lags
    out, phi, error = [1.0], [], r[0]
    for k in range(1, most + 1):
        a = (r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))) / error if error else math.nan
        phi = [p - a * q for p, q in zip(phi, reversed(phi))] + [a]
        error *= 1 - a * a
        out.append(a)
    return out + [math.nan] * (lags - most)


def welch(x: np.ndarray, most: int | None = 256) -> np.ndarray:
    """One-sided power density of each row by Welch's method: Hann windows of min(n, ``most``) values (None: of all n), half
    overlapping, their means taken off."""
    n = min(x.shape[1], most or x.shape[1])
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    pieces = [x[:, i : i + n] for i in range(0, x.shape[1] - n + 1, n - n // 2)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean(1, keepdims=True)) * hann, axis=1)) ** 2 for p in pieces], 0) / max((hann**2).sum(), 1e-300)
    power[:, 1 : None if n % 2 else -1] *= 2
    return power


def _histogram_entropy(x: np.ndarray, bins: int) -> float:
    p = np.histogram(x, bins)[0] / len(x)
    return float(-(p[p > 0] * np.log(p[p > 0])).sum())


def fourier_entropies(x: np.ndarray, bins: tuple[int, ...]) -> np.ndarray:
    out = np.full((len(x), len(bins)), np.nan)
    if x.shape[1] > 1:
        for i, power in enumerate(welch(x)):
            if power.max() > 0:
                out[i] = [_histogram_entropy(power / power.max(), b) for b in bins]
    return out


def permutation_entropy(x: np.ndarray, dimension: int, tau: int = 1) -> np.ndarray:
    n = x.shape[1] - (dimension - 1) * tau
    if n < 1:
        return np.full(len(x), np.nan)
    shapes = np.argsort(np.stack([x[:, i * tau : i * tau + n] for i in range(dimension)], 2), 2, kind="stable")
    code = np.sort((shapes * dimension ** np.arange(dimension)).sum(2), 1)
    # each place's share of its run of equal codes
    new = np.ones_like(code, bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    run = np.cumsum(new.ravel()) - 1
    p = np.bincount(run)[run].reshape(code.shape) / n
    return -np.log(p).mean(1)


def lempel_ziv(x: np.ndarray, bins: int) -> float:
    edges = np.linspace(x.min(), x.max(), bins + 1)[1:]
    s = np.searchsorted(edges, x, side="left").tolist()
    seen, at, length = set(), 0, 1
    while at + length <= len(s):
        piece = tuple(s[at : at + length])
        if piece in seen:
            length += 1
        else:
            seen.add(piece)
            at, length = at + length, 1
    return len(seen) / len(s)


def spectrum(x: np.ndarray) -> np.ndarray:
    """Centroid, variance, skewness and kurtosis of each row's absolute Fourier transform as a distribution of frequencies."""
    power = np.abs(np.fft.rfft(x, axis=1))
    total = power.sum(1)
    with np.errstate(all="ignore"):
        m = [(power * np.arange(power.shape[1]) ** i).sum(1) / total for i in range(5)]
        var = m[2] - m[1] ** 2
        skew = (m[3] - 3 * m[1] * var - m[1] ** 3) / var**1.5
        kurt = (m[4] - 4 * m[1] * m[3] + 6 * m[2] * m[1] ** 2 - 3 * m[1] ** 4) / var**2
    flat = ~(var >= 0.5)
    return np.column_stack([m[1], var, np.where(flat, np.nan, skew), np.where(flat, np.nan, kurt)])


def fourier(x: np.ndarray, most: int = 100) -> np.ndarray:
    """Real, imaginary, absolute and angle (degrees) of coefficients 0 to most - 1 of each row, part by part."""
    f = np.fft.rfft(x, axis=1)[:, :most]
    out = np.full((4, len(x), most), np.nan)
    out[:, :, : f.shape[1]] = f.real, f.imag, np.abs(f), np.degrees(np.angle(f))
    return np.concatenate(list(out), 1)


def ar_coefficients(x: np.ndarray, k: int = 10) -> list[float]:
    n = len(x) - k
    if n < k + 1:
        return [math.nan] * (k + 1)
    design = np.column_stack([np.ones(n), *(x[k - i : k - i + n] for i in range(1, k + 1))])
    return np.linalg.lstsq(design, x[k:], rcond=None)[0].tolist()


#: MacKinnon's approximation of the Dickey-Fuller distribution (with a constant, one series): where the two
#: polynomials meet, the range in which they hold, and their coefficients from the constant on.
DF_MEET, DF_RANGE = -1.61, (-18.83, 2.74)
DF_SMALL = (2.1659, 1.4412, 0.038269)
DF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def dickey_fuller(x: np.ndarray) -> list[float]:
    """Statistic, p-value and number of lags of the augmented test with a constant; lags by Akaike's criterion."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)
    if most < 0 or n < 4 or not d.any():
        return [math.nan] * 3

    def fit(lags: int, lost: int):
        m = len(d) - lost
        design = np.column_stack([x[lost : lost + m], *(d[lost - i : lost - i + m] for i in range(1, lags + 1)), np.ones(m)])
        beta = np.linalg.lstsq(design, d[lost:], rcond=None)[0]
        rest = float(((d[lost:] - design @ beta) ** 2).sum())
        return design, beta, rest, m

    def akaike(lags: int) -> float:
        design, _, rest, m = fit(lags, most)
        return m * math.log(max(rest, 1e-300) / m) + 2 * design.shape[1]

    lags = min(range(most + 1), key=lambda k: (akaike(k), k))
    design, beta, rest, m = fit(lags, lags)
    free = m - design.shape[1]
    spread = np.linalg.pinv(design.T @ design)[0, 0] * rest / free if free > 0 else 0.0
    if spread <= 0:
        return [math.nan] * 3
    t = float(beta[0] / math.sqrt(spread))
    if t > DF_RANGE[1]:
        p = 1.0
    elif t < DF_RANGE[0]:
        p = 0.0
    else:
        z = sum(c * t**i for i, c in enumerate(DF_SMALL if t <= DF_MEET else DF_LARGE))
        p = 0.5 * math.erfc(-z / math.sqrt(2))
    return [t, p, float(lags)]


def friedrich(x: np.ndarray, m: int = 3, r: int = 30) -> list[float]:
    """Coefficients of a polynomial for the mean step by value, over r quantile bins, the highest power first; and the
    largest real part of its roots."""
    if len(x) < 3:
        return [math.nan] * (m + 2)
    edges = np.unique(np.quantile(x[:-1], np.linspace(0, 1, r + 1)))
    which = np.clip(np.searchsorted(edges, x[:-1], side="left") - 1, 0, max(0, len(edges) - 2))
    bins = np.unique(which)
    if len(bins) <= m:
        return [math.nan] * (m + 2)
    step = np.diff(x)
    c = np.polyfit([x[:-1][which == b].mean() for b in bins], [step[which == b].mean() for b in bins], m)
    roots = np.roots(c)
    return [*c.tolist(), float(roots.real.max()) if len(roots) else math.nan]


def ricker(points: int, width: int) -> np.ndarray:
    t = np.arange(points) - (points - 1) / 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - (t / width) ** 2) * np.exp(-((t / width) ** 2) / 2)


def wavelet(x: np.ndarray, width: int) -> np.ndarray:
    """Each row's convolution with a Ricker wavelet of 10 widths (or the row's length)."""
    n = x.shape[1]
    kernel = ricker(min(10 * width, n), width)
    return np.stack([np.convolve(row, kernel, "same") for row in x])


def cwt_coefficients(x: np.ndarray, widths: tuple[int, ...] = (2, 5, 10, 20), most: int = 15) -> np.ndarray:
    out = np.full((len(x), len(widths), most), np.nan)
    k = min(most, x.shape[1])
    for i, w in enumerate(widths):
        out[:, i, :k] = wavelet(x, w)[:, :k]
    return out.reshape(len(x), -1)


def cwt_peaks(x: np.ndarray, n: int) -> float:
    """Local maxima of the Ricker response that stand in every width up to n."""
    keep = None
    for w in range(1, n + 1):
        y = wavelet(x[None], w)[0]
        top = set((np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])) + 1).tolist()) if len(y) > 2 else set()
        keep = top if keep is None else {p for p in keep if any(abs(p - q) <= w for q in top)}
    return float(len(keep or ()))


def _near(x: np.ndarray, m: int, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of m values how many runs are within ``far`` in every value, the same among all runs but the last, and for
    each run of m + 1 values.  Rows of the symmetric table of all pairs are made some at a time and added up."""
    n = len(x)
    rows = max(1, min(255, (1 << 17) // n))  # counts of a part fit a byte, its differences the cache
    short, but_last, long = np.zeros(n - m + 1, np.int64), np.zeros(n - m, np.int64), np.zeros(n - m, np.int64)
    for lo in range(0, n - m + 1, rows):
        hi = min(lo + rows, n - m + 1)
        part = x[lo : hi + m, None] - x
        close = (np.abs(part, out=part) <= far).view(np.uint8)
        k = hi - lo
        both = close[:k, : n - m + 1].copy()
        for j in range(1, m):
            both &= close[j : j + k, j : j + n - m + 1]
        short += both.sum(0, dtype=np.uint8)
        both = both[: min(hi, n - m) - lo, : n - m]
        but_last += both.sum(0, dtype=np.uint8)
        both &= close[m : m + len(both), m:]
        long += both.sum(0, dtype=np.uint8)
    return short, but_last, long


def entropies(x: np.ndarray, m: int = 2, r: float = 0.2) -> list[float]:
    """Sample entropy and approximate entropy."""
    n = len(x)
    if n <= m + 1:
        return [math.nan, 0.0]
    short, but_last, long = _near(x, m, r * x.std())
    pairs, longer = int(but_last.sum()) - (n - m), int(long.sum()) - (n - m)
    sample = -math.log(longer / pairs) if pairs and longer else math.nan
    return [sample, abs(float(np.log(short / (n - m + 1)).mean()) - float(np.log(long / (n - m)).mean()))]


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    return entropies(x, m, r)[0]


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    return entropies(x, m, r)[1]


def trend_p(x: np.ndarray) -> float:
    """Two-sided p of Student's t (by its integral) of the slope."""
    n = len(x)
    if n < 3:
        return math.nan
    t = np.arange(n) - (n - 1) / 2
    slope = (x * t).sum() / (t * t).sum()
    rest = x - x.mean() - slope * t
    error = math.sqrt(max(0.0, (rest @ rest) / (n - 2) / (t * t).sum()))
    if error == 0:
        return 0.0 if slope else 1.0
    df, v = n - 2, abs(slope / error)
    grid = np.linspace(0, math.atan(v / math.sqrt(df)), 2001)
    y = np.cos(grid) ** (df - 1)
    inside = float(((y[1:] + y[:-1]) / 2 * np.diff(grid)).sum()) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return max(0.0, 1 - 2 * inside)


def aggregated_autocorrelation(x: np.ndarray, most: int = 40) -> np.ndarray:
    """Mean, median and variance over lags 1 to ``most`` of each row's autocorrelation."""
    n, c, var = x.shape[1], x - x.mean(1, keepdims=True), x.var(1)
    if n < 2:
        return np.zeros((len(x), 3))
    with np.errstate(all="ignore"):
        r = np.stack([(c[:, : n - k] * c[:, k:]).sum(1) / (n - k) / var for k in range(1, min(most, n - 1) + 1)], 1)
    r[var < 1e-10] = 0
    return np.column_stack([r.mean(1), np.median(r, 1), r.var(1)])


def _scaled_runs(x: np.ndarray, k: int) -> np.ndarray:
    runs = np.lib.stride_tricks.sliding_window_view(x, k).astype(float)
    spread = runs.std(1, keepdims=True)
    return np.where(spread > 0, (runs - runs.mean(1, keepdims=True)) / np.where(spread > 0, spread, 1), 0.0)


def query_similarity_count(x: np.ndarray, query: Iterable[float] | None = None, threshold: float = 0.0) -> float:
    """Runs of the values whose scaled distance to the scaled query is at most ``threshold``; 0 without a query of three."""
    query = np.array([] if query is None else list(query), float)
    if len(query) < 3 or len(x) < len(query):
        return 0.0
    return float((np.sqrt(((_scaled_runs(x, len(query)) - _scaled_runs(query, len(query))) ** 2).sum(1)) <= threshold + 1e-9).sum())


#: Runs from which on the matrix profile goes by diagonals.
MANY_RUNS = 400


def _nearest(x: np.ndarray, k: int, far: int) -> np.ndarray:
    """Each scaled run's distance to its nearest run more than ``far`` places away."""
    runs = _scaled_runs(x, k)
    nearest = np.empty(len(runs))
    for i, run in enumerate(runs):
        gap = np.sqrt(((runs - run) ** 2).sum(1))
        gap[max(0, i - far) : i + far + 1] = np.inf
        nearest[i] = gap.min()
    return nearest


def _nearest_by_diagonals(x: np.ndarray, k: int, far: int) -> np.ndarray:
    """The same: covariances of all pairs of runs, one diagonal after another by what enters and what leaves from step to
    step, tell each run's nearest; its distance is taken from the two runs themselves."""
    runs = np.lib.stride_tricks.sliding_window_view(x, k)
    m = len(runs)
    mean, spread = np.empty(m), np.empty(m)
    for lo in range(0, m, 256):
        part = runs[lo : lo + 256]
        mean[lo : lo + 256] = part.mean(1)
        spread[lo : lo + 256] = np.where(part.max(1) > part.min(1), part.std(1), 0.0)
    full = spread > 0
    scale = np.where(full, 1 / np.where(full, spread * math.sqrt(k), 1), 0.0)
    # squared distance over k: 2 - 2 r, 1 where one of the two is level, 0 where both are
    half = full / 2
    first = np.correlate(x - x.mean(), x[:k] - mean[0], "valid")
    df, dg = np.zeros(m), np.zeros(m)
    df[1:] = (x[k:] - x[: m - 1]) / 2
    dg[1:] = (x[k:] - mean[1:]) + (x[: m - 1] - mean[:-1])
    best, to = np.full(m, -np.inf), np.full(m, -1)
    for d in range(far + 1, m):
        alike = df[: m - d] * dg[d:]
        alike += df[d:] * dg[: m - d]
        alike[0] = first[d]
        np.cumsum(alike, out=alike)
        alike *= scale[: m - d]
        alike *= scale[d:]
        if not full.all():
            alike -= half[: m - d]
            alike -= half[d:]
        for lo, hi, way in ((0, m - d, d), (d, m, -d)):
            more = np.flatnonzero(alike > best[lo:hi])
            if len(more):
                best[lo + more] = alike[more]
                to[lo + more] = lo + more + way
    out = np.full(m, np.inf)
    at = np.flatnonzero(to >= 0)
    for lo in range(0, len(at), 256):
        i = at[lo : lo + 256]
        a, b = ((runs[j] - mean[j, None]) * (scale[j] * math.sqrt(k))[:, None] for j in (i, to[i]))
        out[i] = np.sqrt(((a - b) ** 2).sum(1))
    return out


def matrix_profile(x: np.ndarray) -> list[float]:
    """Minimum, maximum, mean, median and quartiles of each run's distance to its nearest scaled run at least a quarter of
    a run away; runs are a quarter of the window (four values at least)."""
    k = max(4, len(x) // 4)
    if len(x) < 2 * k:
        return [math.nan] * 6
    p = (_nearest if len(x) - k < MANY_RUNS else _nearest_by_diagonals)(x, k, max(1, -(-k // 4)))
    return [float(v) for v in (p.min(), p.max(), p.mean(), np.median(p), np.quantile(p, 0.25), np.quantile(p, 0.75))] if np.isfinite(p).all() else [math.nan] * 6


_CORRIDORS = [(lo, hi) for lo in (0.0, 0.2, 0.4, 0.6, 0.8) for hi in (0.2, 0.4, 0.6, 0.8, 1.0) if lo < hi]


def change_quantiles(x: np.ndarray) -> list[float]:
    """Mean and variance of the steps, and of their sizes, that begin and end in each corridor of quantiles; 0 without one."""
    s, step, out = np.sort(x), np.diff(x), []
    for corridor in _CORRIDORS:
        at = [round((len(x) - 1) * q, 9) for q in corridor]
        a, b = (s[int(p)] + (s[min(int(p) + 1, len(s) - 1)] - s[int(p)]) * (p - int(p)) for p in at)
        inside = (x >= a) & (x <= b)
        some = step[inside[1:] & inside[:-1]]
        for y in (some, np.abs(some)):
            out += [float(y.mean()), float(y.var())] if len(y) else [0.0, 0.0]
    return out


def _each(f: Callable[[np.ndarray], float | list[float]]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.array([np.atleast_1d(f(row)) for row in x], float)


_COEFFS = range(100)
#: Names, and a function from windows of one length (a row each) to a row of values each; NaN is no value.
FAMILIES: list[tuple[list[str], Callable[[np.ndarray], np.ndarray]]] = [
    ([f"partial_autocorrelation__lag_{k}" for k in range(10)], _each(pacf)),
    ([f"spkt_welch_density__coeff_{k}" for k in (2, 5, 8)], lambda x: _pick(welch(x) if x.shape[1] > 1 else np.zeros((len(x), 0)), (2, 5, 8))),
    ([f"permutation_entropy__dimension_{d}__tau_1" for d in range(3, 8)], lambda x: np.column_stack([permutation_entropy(x, d) for d in range(3, 8)])),
    ([f"lempel_ziv_complexity__bins_{b}" for b in (2, 3, 5, 10, 100)], _each(lambda x: [lempel_ziv(x, b) for b in (2, 3, 5, 10, 100)])),
    ([f"fourier_entropy__bins_{b}" for b in (2, 3, 5, 10, 100)], lambda x: fourier_entropies(x, (2, 3, 5, 10, 100))),
    ([f"fft_aggregated__aggtype_{w}" for w in ("centroid", "variance", "skew", "kurtosis")], spectrum),
    ([f"fft_coefficient__attr_{p}__coeff_{k}" for p in ("real", "imag", "abs", "angle") for k in _COEFFS if k > 7], lambda x: fourier(x)[:, [100 * p + k for p in range(4) for k in _COEFFS if k > 7]]),
    ([f"ar_coefficient__coeff_{c}__k_10" for c in range(11)], _each(ar_coefficients)),
    ([f"augmented_dickey_fuller__attr_{a}" for a in ("teststat", "pvalue", "usedlag")], _each(dickey_fuller)),
    ([*(f"friedrich_coefficients__coeff_{c}__m_3__r_30" for c in range(4)), "max_langevin_fixed_point__m_3__r_30"], _each(friedrich)),
    ([f"cwt_coefficients__coeff_{c}__w_{w}" for w in (2, 5, 10, 20) for c in range(15)], cwt_coefficients),
    ([f"number_cwt_peaks__n_{n}" for n in (1, 5)], _each(lambda x: [cwt_peaks(x, n) for n in (1, 5)])),
    (["linear_trend__attr_pvalue"], _each(trend_p)),
    ([f"agg_autocorrelation__f_agg_{f}__maxlag_40" for f in ("mean", "median", "var")], aggregated_autocorrelation),
    (["query_similarity_count__query_None__threshold_0.0"], _each(query_similarity_count)),
    ([f"matrix_profile__feature_{f}" for f in ("min", "max", "mean", "median", "25", "75")], _each(matrix_profile)),
]
#: No part of the efficient set: on request.  The entropies are quadratic in the window's length; the density of one piece as
#: long as the window is the limit of Welch's method without means over pieces.
ON_REQUEST = [
    (["sample_entropy", "approximate_entropy__m_2__r_0.2"], _each(entropies)),
    ([f"spkt_density__coeff_{k}" for k in (2, 5, 8)], lambda x: _pick(welch(x, None) if x.shape[1] > 1 else np.zeros((len(x), 0)), (2, 5, 8))),
]


#: Expressions too, but of a lambda with quantiles inside: the whole set takes them from here.
FASTER = [([f"change_quantiles__f_agg_{agg}__isabs_{absolute}__qh_{hi}__ql_{lo}" for lo, hi in _CORRIDORS for absolute in (False, True) for agg in ("mean", "var")], _each(change_quantiles))]


def _pick(x: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
    return np.column_stack([x[:, c] if c < x.shape[1] else np.full(len(x), np.nan) for c in columns])


def arrow_names() -> list[str]:
    return [n for names, _ in FAMILIES for n in names]


def compute(windows: list[np.ndarray], names: list[str]) -> np.ndarray:
    """A row for each window, a column for each name; windows of one length are computed together."""
    known = {n: (f, i) for family, f in (*FAMILIES, *ON_REQUEST, *FASTER) for i, n in enumerate(family)}
    out = np.full((len(windows), len(names)), np.nan)
    lengths = np.array([len(w) for w in windows])
    for n in np.unique(lengths[lengths > 0]).tolist():
        mine = np.flatnonzero(lengths == n)
        x, done = np.stack([windows[i] for i in mine]), {}
        for c, name in enumerate(names):
            f, i = known[name]
            if id(f) not in done:
                done[id(f)] = f(x)
            out[mine, c] = done[id(f)][:, i]
    out[~np.isfinite(out)] = np.nan
    return out


def _arrow(pieces: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*by).schema]

    def work(batches):
        for batch in batches:
            values = batch.column(len(by))
            flat, ends = values.flatten().to_numpy(zero_copy_only=False).astype(float), values.offsets.to_numpy()
            got = compute(np.split(flat, (ends[1:-1] - ends[0])) if batch.num_rows else [], names)
            columns = [pa.array(c, pa.float64(), from_pandas=True) for c in got.T]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(by))), *columns], [*by, *names])

    return pieces.select(*by, "__x").mapInArrow(work, ", ".join(fields + [f"`{n}` double" for n in names]))


def extract_arrow(long: DataFrame, by: list[str], names: Iterable[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Calculators that need a recursion, a transform or a matrix, in one Arrow pass over the window arrays."""
    return _arrow(arrays(long, by, ts, value), by, list(names) if names is not None else arrow_names())


def tall(features: DataFrame, by: list[str]) -> DataFrame:
    return features.unpivot(by, [F.col(f"`{c}`") for c in features.columns if c not in by], "feature", "value")


def wide(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return rows.groupBy(*by).pivot("feature", names).agg(F.first("value"))
