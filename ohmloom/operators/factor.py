"""Non-negative matrix factorisation X ~ W H: rows stay on the executors, H (k by d) on the driver.

Each round sends H out with the tasks, solves every row's W by coordinate descent, and brings back two sums, W'X (k by d)
and W'W (k by k), whatever the number of rows.  W is never kept: it follows from H.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SEED = 42


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def solve_w(x: np.ndarray, h: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """W >= 0 of least |x - W h|^2 for each row, by cyclic coordinate descent."""
    gram, target = h @ h.T, x @ h.T
    w = np.maximum(0, target / np.maximum(np.diag(gram).sum(), 1e-12))
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(h)):
            if gram[k, k] <= 0:
                continue
            new = np.maximum(0, w[:, k] + (target[:, k] - w @ gram[:, k]) / gram[k, k])
            moved = max(moved, float(np.abs(new - w[:, k]).max(initial=0)))
            w[:, k] = new
        if moved < tol:
            break
    return w


def update_h(h: np.ndarray, wx: np.ndarray, ww: np.ndarray, rounds: int = 20) -> np.ndarray:
    h = h.copy()
    for _ in range(rounds):
        for k in range(len(h)):
            if ww[k, k] > 0:
                h[k] = np.maximum(0, h[k] + (wx[k] - ww[k] @ h) / ww[k, k])
    return h


def start_h(gram: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    """NNDSVD from the d by d Gram matrix: the stronger sign of each singular vector; zeros become the mean."""
    value, vector = np.linalg.eigh(gram)
    h = []
    for j in np.argsort(-value)[:k]:
        v = vector[:, j]
        up, down = np.maximum(v, 0), np.maximum(-v, 0)
        h.append((up if np.linalg.norm(up) >= np.linalg.norm(down) else down) * np.sqrt(np.sqrt(max(value[j], 0))))
    h += [mean] * (k - len(h))
    out = np.array(h)
    return np.where(out <= 0, mean.mean() / 100 + 1e-9, out)


def _sums(rows: DataFrame, vector: str, size: int, make, context: str | None = None) -> dict:
    """Per context (None: all rows together) the sum over its rows of a flat array that ``make(x, context)`` derives from a
    matrix of rows: one partial sum a task and context, so the driver gets contexts * size numbers, whatever the rows."""
    kind = rows.schema[context].dataType.simpleString() if context else "string"

    def work(batches):
        totals: dict = {}
        for batch in batches:
            x = _matrix(batch.column(0))
            if context is None:
                groups = {None: x} if len(x) else {}
            else:
                names = np.array(batch.column(1).to_pylist(), object)
                groups = {c: x[[n == c for n in names]] for c in set(names.tolist())}
            for c, part in groups.items():
                got = make(part, c)
                if got is not None:
                    totals[c] = totals.get(c, 0) + got
        for c, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * size, to_arrow_type(kind_type)), pa.array(range(size), pa.int32()), pa.array(total)], ["c", "i", "s"])

    kind_type = rows.schema[context].dataType if context else T.StringType()
    chosen = rows.select(vector, *([context] if context else []))
    got = chosen.mapInArrow(work, f"c {kind}, i int, s double").groupBy("c", "i").agg(F.sum("s").alias("s")).collect()
    out: dict = {}
    for r in got:
        out.setdefault(r["c"], np.zeros(size))[r["i"]] = r["s"]
    return out


def _fit(rows: DataFrame, k: int, vector: str, rounds: int, tol: float, context: str | None, least: int) -> dict:
    """A model for each context of at least ``least`` rows, all in the same passes; a context that has converged rests."""
    first = rows.select(vector).first()
    if first is None:
        return {}
    d = len(first[0])
    stats = _sums(rows, vector, d * d + d + 1, lambda x, c: np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]]), context)
    stats = {c: v for c, v in stats.items() if v[-1] >= least}
    grams = {c: v[: d * d].reshape(d, d) for c, v in stats.items()}
    models = {c: start_h(grams[c], v[d * d : -1] / v[-1], k) for c, v in stats.items()}
    last, active = dict.fromkeys(models, np.inf), set(models)
    for _ in range(rounds):
        if not active:
            break
        now = {c: models[c] for c in active}

        def make(x, c, now=now):
            if c not in now:
                return None
            w = solve_w(x, now[c])
            return np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])

        for c, sums in _sums(rows, vector, k * d + k * k, make, context).items():
            wx, ww = sums[: k * d].reshape(k, d), sums[k * d :].reshape(k, k)
            h = models[c] = update_h(models[c], wx, ww)
            loss = float(np.trace(grams[c]) - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum())
            if last[c] - loss <= tol * max(abs(last[c]) if np.isfinite(last[c]) else loss, 1e-12):
                active.discard(c)
            last[c] = loss
    return models


def fit(rows: DataFrame, k: int, vector: str = "x", rounds: int = 500, tol: float = 1e-4) -> np.ndarray:
    """At most ``rounds`` passes; ends when a pass takes off less than ``tol`` of the squared error."""
    return _fit(rows, k, vector, rounds, tol, None, 1).get(None, np.zeros((k, 0)))


def sweep(rows: DataFrame, ks: tuple[int, ...] = (3, 5, 8, 10), vector: str = "x", rounds: int = 500) -> DataFrame:
    """k and the mean residual of a model of each size."""
    out = None
    for k in ks:
        one = transform(rows.select(vector), fit(rows, k, vector, rounds), vector).agg(F.lit(k).alias("k"), F.avg("residual").alias("residual"))
        out = one if out is None else out.unionByName(one)
    return out


def transform(rows: DataFrame, h: np.ndarray, vector: str = "x") -> DataFrame:
    """``rows`` with w array<double> and residual, the mean squared error over the columns."""
    names = rows.columns

    def work(batches):
        for batch in batches:
            x = _matrix(batch.column(names.index(vector)))
            w = solve_w(x, h) if len(x) else np.zeros((0, len(h)))
            residual = ((x - w @ h) ** 2).mean(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w.tolist(), pa.list_(pa.float64())), pa.array(residual)], [*names, "w", "residual"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{fields}, w array<double>, residual double")


def fit_by_context(rows: DataFrame, context: str, k: int = 5, least: int = 20, vector: str = "x", rounds: int = 2000, tol: float = 1e-4) -> dict:
    """A model for each context of at least ``least`` rows, fitted side by side; contexts are few, their rows stay where
    they are."""
    return {c: h for c, h in _fit(rows.where(F.col(context).isNotNull()), k, vector, rounds, tol, context, least).items()}


def transform_by_context(rows: DataFrame, models: dict[str, np.ndarray], context: str, vector: str = "x") -> DataFrame:
    """``rows`` with residual and scored; a context without a model has residual 0 and is not scored."""
    names = rows.columns

    def work(batches):
        for batch in batches:
            contexts = np.array(batch.column(names.index(context)).to_pylist(), object)
            x, residual, scored = _matrix(batch.column(names.index(vector))), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for c, h in models.items():
                mine = contexts == c
                if mine.any():
                    residual[mine], scored[mine] = ((x[mine] - solve_w(x[mine], h) @ h) ** 2).mean(1), True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(residual), pa.array(scored)], [*names, "residual", "scored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{fields}, residual double, scored boolean")


def components(transformed: DataFrame, k: int, key: str = "window_id") -> DataFrame:
    return transformed.select(key, *[F.get("w", F.lit(i)).alias(f"nmf_component_{i + 1}") for i in range(k)])
