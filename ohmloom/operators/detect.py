"""Outlier detectors: id and score of every row; tall input (id, feature, value) or vectors (id, x array<double>)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.io import cut
from .factor import _matrix
from .ranks import running

BINS = 10
BLOCK_ROWS = 4096
TRAIN_ROWS = 20_000
SEED = 42


def hbos(rows: DataFrame, bins: int = BINS, alpha: float = 0.1, key: str = "id") -> DataFrame:
    """Histogram score: the sum over features of -log2(relative height + alpha)."""
    stats = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"))).otherwise(0)
    placed = rows.join(stats, "feature").withColumn("bin", place)
    counts = placed.groupBy("feature", "bin").agg(F.count("*").alias("c"))
    tops = counts.groupBy("feature").agg(F.max("c").alias("top"))
    heights = counts.join(tops, "feature").select("feature", "bin", (-F.log2(F.col("c") / F.col("top") + alpha)).alias("s"))
    return placed.join(heights, ["feature", "bin"]).groupBy(key).agg(F.sum("s").alias("score"))


def _tails(rows: DataFrame, key: str) -> DataFrame:
    """-ln of both empirical tails of each value, and the feature's skewness.  Distinct values are ranked, not rows."""
    counts = rows.groupBy("feature", "value").agg(F.count("*").alias("c"))
    ranked = running(counts, ["feature"], "value", "c", "below", "n")
    tails = ranked.select("feature", "value", (-F.ln(F.col("below") / F.col("n"))).alias("l"), (-F.ln((F.col("n") - F.col("below") + F.col("c")) / F.col("n"))).alias("r"))
    skews = rows.groupBy("feature").agg(F.coalesce(F.skewness("value"), F.lit(0.0)).alias("skew"))
    return rows.join(tails, ["feature", "value"]).join(skews, "feature")


def ecod(rows: DataFrame, key: str = "id") -> DataFrame:
    l, r, skew = F.col("l"), F.col("r"), F.col("skew")
    s = F.when(skew < 0, l).when(skew > 0, r).otherwise(l + r)
    return _tails(rows, key).groupBy(key).agg(F.sum(F.greatest(l, r, s)).alias("score"))


def copod(rows: DataFrame, key: str = "id") -> DataFrame:
    l, r, skew = F.col("l"), F.col("r"), F.col("skew")
    s = F.when(skew < 0, l).when(skew > 0, r).otherwise(l + r)
    return _tails(rows, key).groupBy(key).agg(F.sum(F.greatest(s, (l + r) / 2)).alias("score"))


def neighbours(vectors: DataFrame, k: int = 20, key: str = "id", blocks: int | None = None) -> DataFrame:
    """id, neighbour, dist, place: the k nearest of every row.  Blocks of rows meet blocks of rows, each meeting keeps k
    candidates a row; ties go to the smaller id."""
    # blocks of at most BLOCK_ROWS rows: what a meeting holds does not grow with the table
    n = blocks or max(1, -(-vectors.count() // BLOCK_ROWS))
    dealt = vectors.select(F.col(key).alias("id"), "x", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = dealt.select("id", "x", F.col("b").alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    gives = dealt.select("id", "x", every.alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"))

    def meet(group: pa.Table) -> pa.Table:
        ask, ids, x = group.column("asks").to_numpy(), group.column("id").to_numpy(), _matrix(group.column("x").combine_chunks())
        q, d, qi, di = x[ask], x[~ask], ids[ask], ids[~ask]
        order = np.argsort(di, kind="stable")
        d, di = d[order], di[order]
        out = []
        for i in range(0, len(q) if len(d) else 0, 512):
            # expanded squares choose, with room for what cancels, and the chosen are measured anew
            part = q[i : i + 512]
            gap = np.sqrt(np.maximum(0, (part * part).sum(1)[:, None] - 2 * part @ d.T + (d * d).sum(1)))
            gap[qi[i : i + 512, None] == di[None]] = np.inf
            more = min(2 * k, gap.shape[1])
            for row in range(len(gap)):
                limit = np.partition(gap[row], more - 1)[more - 1]
                some = np.flatnonzero((gap[row] <= limit) & np.isfinite(gap[row]))
                dist = np.sqrt(((part[row] - d[some]) ** 2).sum(1))
                order = np.argsort(dist, kind="stable")[:k]
                out.append((np.full(len(order), qi[i + row]), di[some[order]], dist[order]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.table({"id": pa.array(cols[0].astype(np.int64)), "neighbour": pa.array(cols[1].astype(np.int64)), "dist": pa.array(cols[2].astype(float))})

    found = asks.unionByName(gives).groupBy("i", "j").applyInArrow(meet, "id long, neighbour long, dist double")
    order = Window.partitionBy("id").orderBy("dist", "neighbour")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def lof(vectors: DataFrame, k: int = 20, key: str = "id") -> DataFrame:
    near = cut(neighbours(vectors, k, key), "neighbours")
    reach = near.groupBy("id").agg(F.max("dist").alias("kdist"))
    dense = near.join(reach.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id").agg((1 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd"))
    others = dense.select(F.col("id").alias("neighbour"), F.col("lrd").alias("lrd_n"))
    return near.join(others, "neighbour").groupBy("id").agg(F.avg("lrd_n").alias("m")).join(dense, "id").select(F.col("id").alias(key), (F.col("m") / F.col("lrd")).alias("score"))


def _c(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def isolation_forest(vectors: DataFrame, trees: int = 100, sample: int = 256, key: str = "id", seed: int = SEED) -> DataFrame:
    """Trees over seeded samples of at most ``sample`` rows each (trees * sample rows at the driver, whatever the input)."""
    n = trees * sample
    rows = vectors.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).limit(n).select("x").collect()
    data, rng = np.array([r[0] for r in rows], float), np.random.default_rng(seed)
    if not len(data):
        return vectors.select(key, F.lit(0.0).alias("score"))
    size = min(sample, len(data))
    forest = []
    for _ in range(trees):
        some, nodes = data[rng.choice(len(data), size, replace=False)], []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _c(len(part))])
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
            if depth < np.ceil(np.log2(max(2, size))) and len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                left = part[:, f] < cut
                nodes[at][:4] = [f, cut, grow(part[left], depth + 1), grow(part[~left], depth + 1)]
            return at

        grow(some, 0)
        forest.append(np.array(nodes))

    def work(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            depth = np.zeros(len(x))
            for nodes in forest:
                at = np.zeros(len(x), int)
                while True:
                    inner = nodes[at, 0] >= 0
                    if not inner.any():
                        break
                    f, go = nodes[at, 0].astype(int), np.zeros(len(x), bool)
                    go[inner] = x[inner, f[inner]] < nodes[at[inner], 1]
                    at = np.where(inner, np.where(go, nodes[at, 2], nodes[at, 3]).astype(int), at)
                depth += nodes[at, 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2 ** (-depth / trees / max(_c(size), 1e-9)))], [key, "score"])

    return vectors.select(key, "x").mapInArrow(work, f"{key} {dict(vectors.dtypes)[key]}, score double")


class Network:
    """A fully connected auto-encoder in numpy; with ``latent`` > 0 a variational one."""

    def __init__(self, sizes: list[int], latent: int = 0, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.latent, self.rng = latent, rng
        self.w = [rng.normal(0, np.sqrt(2 / (a + b)), (a, b)) for a, b in zip(sizes[:-1], sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.w, *self.b)])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for p in (*self.w, *self.b):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def run(self, x: np.ndarray, noise: bool = False):
        acts, middle, extra = [x], len(self.w) // 2 - 1, None
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            z = acts[-1] @ w + b
            if self.latent and i == middle:
                mu, log = z[:, : self.latent], np.clip(z[:, self.latent :], -8, 8)
                eps = self.rng.normal(size=mu.shape) if noise else np.zeros_like(mu)
                extra = (mu, log, eps)
                acts.append(mu + eps * np.exp(log / 2))
            else:
                acts.append(np.maximum(z, 0) if i < len(self.w) - 1 else z)
        return acts, extra

    def fit(self, x: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 1e-3) -> "Network":
        first = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        step, middle = 0, len(self.w) // 2 - 1
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                part = x[order[lo : lo + batch]]
                acts, extra = self.run(part, True)
                delta, gw, gb = 2 * (acts[-1] - part) / len(part), [None] * len(self.w), [None] * len(self.w)
                for i in reversed(range(len(self.w))):
                    if self.latent and i == middle:
                        mu, log, eps = extra
                        delta = np.hstack([delta + mu / len(part), delta * eps * np.exp(log / 2) / 2 + (np.exp(log) - 1) / 2 / len(part)])
                    elif i < len(self.w) - 1:
                        delta = delta * (acts[i + 1] > 0)
                    gw[i], gb[i] = acts[i].T @ delta, delta.sum(0)
                    delta = delta @ self.w[i].T
                step += 1
                for p, g, m in zip((*self.w, *self.b), (*gw, *gb), first):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        return self

    def error(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.run(x)[0][-1] - x) ** 2).sum(1))


def auto_encoder(vectors: DataFrame, hidden: tuple[int, ...] = (128, 64, 32, 64, 128), epochs: int = 30, batch: int = 64, key: str = "id", seed: int = SEED) -> DataFrame:
    """Reconstruction error of every row by a network trained on all rows."""
    return _reconstruction(vectors, lambda d: Network([d, *hidden, d], 0, seed), epochs, batch, key)


def variational(vectors: DataFrame, encoder: tuple[int, ...] = (128, 64, 32), decoder: tuple[int, ...] = (32, 64, 128), latent: int = 2, epochs: int = 30, batch: int = 64, key: str = "id", seed: int = SEED) -> DataFrame:
    """The same by a variational auto-encoder."""

    def make(d: int) -> Network:
        net, rest = Network([d, *encoder, 2 * latent], latent, seed), Network([latent, *decoder, d], 0, seed + 1)
        net.w, net.b = net.w + rest.w, net.b + rest.b
        return net

    return _reconstruction(vectors, make, epochs, batch, key)


def _scale(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and deviation of each component over all rows (a deviation of 0 is 1), and the number of rows."""
    got = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    return np.array([r.m for r in got]), np.array([r.s or 1.0 for r in got]), got[0].n if got else 0


def _round(weights: np.ndarray, make, mean: np.ndarray, scale: np.ndarray, epochs: int, batch: int, done: int):
    """Trains one part from ``weights``: index and value of its weights times its rows, and last its rows."""

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        own = make(len(mean)).load(weights)
        own.rng = np.random.default_rng([SEED, done, group.column("part")[0].as_py()])
        x = (_matrix(group.column("x").combine_chunks()) - mean) / scale
        own.fit(x, epochs, batch)
        flat = np.append(own.flat() * len(x), len(x))
        return pa.table({"i": pa.array(range(len(flat)), pa.int32()), "v": pa.array(flat)})

    return train


def _reconstruction(vectors: DataFrame, make, epochs: int, batch: int, key: str) -> DataFrame:
    """Train on all rows and score all rows.

    Rows are dealt to parts of about TRAIN_ROWS by their key.  One part is trained in one task, all epochs on end; several
    parts train an epoch each from the same weights, and the weights' means, by the parts' rows, begin the next epoch: the
    driver gets one network's weights a round, however many rows there are.
    """
    mean, scale, n = _scale(vectors)
    if not n:
        return vectors.select(key, F.lit(0.0).alias("score"))
    parts = -(-n // TRAIN_ROWS)
    dealt = vectors.select("x", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.xxhash64(key).alias("at"))
    dealt = cut(dealt, "encoder") if parts > 1 else dealt
    net = make(len(mean))
    for done in range(0, epochs, epochs if parts == 1 else 1):
        train = _round(net.flat(), make, mean, scale, epochs if parts == 1 else 1, batch, done)
        sums = dealt.groupBy("part").applyInArrow(train, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        net.load(np.array([r.v for r in sums[:-1]]) / sums[-1].v)

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.error((_matrix(b.column(1)) - mean) / scale) if b.num_rows else np.zeros(0))], [key, "score"])

    return vectors.select(key, "x").mapInArrow(work, f"{key} {dict(vectors.dtypes)[key]}, score double")


def flag(scores: DataFrame, contamination: Column | float, score: str = "score") -> DataFrame:
    """is_outlier: the score lies above the (1 - contamination) quantile."""
    share = contamination if isinstance(contamination, float) else float(contamination)
    cut = scores.agg(F.percentile(score, 1 - share).alias("__cut"))
    return scores.join(F.broadcast(cut)).withColumn("is_outlier", (F.col(score) > F.col("__cut")).cast("int")).drop("__cut")  # one row
