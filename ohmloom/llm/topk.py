"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become integers, floor(scale * x).

1. Pivots: ``n_pivots`` data vectors, those with the smallest hash; every vector, and every query, joins the cell of its
   nearest pivot.
2. Summaries: per cell the greatest distance R to the pivot and the k least distances (bounded by n_pivots * (k + 2)
   numbers, whatever the input); per query cell the greatest distance U.
3. Bounds, by Cauchy and Schwarz: a query q of cell i scores p_i.s - U_i |s| at least and p_i.s + U_i |s| at most with a
   vector s.  For the k vectors nearest to p_j the summaries know p_i.s >= p_i.p_j - |p_i| |p_j s|, so the k-th highest of
   these bounds is a score tau_i that k neighbours of every query of the cell reach.  A data cell j with
   p_i.p_j + |p_i| R_j + U_i (|p_j| + R_j) < tau_i is ruled out; of the others a vector is needed if p_i.s + U_i |s| >= tau_i.
4. Replication: query cells are packed into groups of about ``group_queries`` neighbouring queries (a large cell is cut
   into several).  A data vector goes once to each group in which some cell needs it, marked with the cells that do,
   and there to one of many blocks, so a group or cell of any size is spread over tasks.
5. Local solution: each (group, block) gives every query its k best of the block's vectors that its cell needs, by exact
   integer products; the k best of those are the result.  Ties go to the smaller vec_id.

What is pruned depends on the data: tight clusters leave each cell its own cluster; vectors spread evenly over a sphere of
many dimensions are all about equally far apart, so every cell needs all of them and each is still moved only once a group.

Products are taken in floating point where they and all their partial sums stay below 2^52, in 64-bit integers where
they stay below 2^63, else in Python's integers.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part; vectors of unequal
lengths are an error, and so are a component or a score beyond 64 bits; an exactly repeated (vec_id, vector) counts once; a
query's own vec_id is no candidate; fewer than k candidates give fewer rows; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, parts_for, shuffle_partitions, table

K = 10
SCALE = 1024
PIVOTS = 64
GROUP_QUERIES = 2048
STEP_ROWS = 4096
BLOCK_BYTES = 4 << 20
#: Bounds are rounded floats: they are widened by this share of the largest squared norm.
SLACK = 1e-9


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Distinct (id, v array<bigint>) of the vectors that take part."""
    v = F.col(vector_col)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    ints = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < F.lit(9.2e18), F.floor(scaled(x)).cast("long")).otherwise(F.raise_error(F.lit("a component beyond 64 bits")).cast("long")))
    return rows.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), ints.alias("v")).distinct()


def _integers(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if n and (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal lengths")
    return flat.reshape(n, -1).astype(np.int64, copy=False) if n else np.zeros((0, 0), np.int64)


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: no partial sum, in whatever order, exceeds the sum of the greatest products."""
    most = sum(int(a) * int(b) for a, b in zip(np.abs(q.astype(float)).max(0, initial=0), np.abs(d.astype(float)).max(0, initial=0)))
    if most < 1 << 52:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return q @ d.T
    return (q.astype(object) @ d.astype(object).T)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)))


def _cells(pivots: np.ndarray):
    """Assigns rows (id, v) to the nearest pivot."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(lo, STEP_ROWS)
                x = _integers(part.column(1)).astype(float)
                cell = _distances(x, pivots).argmin(1)
                # the chosen distance anew, without the cancellation of the expanded square
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(dist)], ["id", "v", "cell", "dist"])

    return work


_CELL_SCHEMA = "id long, v array<long>, cell int, dist double"


class Bounds:
    """What the summaries say: which data a query cell may need, and the groups in which query cells are solved."""

    def __init__(self, pivots: np.ndarray, summary: dict, reach: dict, k: int, group_queries: int):
        between = _distances(pivots, pivots)
        dots, norms = pivots @ pivots.T, np.sqrt((pivots * pivots).sum(1))
        n = len(pivots)
        far = np.array([summary[j]["far"] if j in summary else 0.0 for j in range(n)])
        self.slack = SLACK * float((norms + far).max()) ** 2 + 1e-9
        self.u = np.array([reach[i][0] if i in reach else 0.0 for i in range(n)])
        self.least = np.full(n, np.inf)  # the score that all queries of a cell reach k times; infinite without queries
        self.whole = np.zeros((n, n), bool)  # data cell, query cell: not ruled out by the summaries
        for i, (u, _) in reach.items():
            lower = np.concatenate([dots[i, j] - norms[i] * (d := np.array(s["least"])) - u * (norms[j] + d) for j, s in summary.items()])
            self.least[i] = np.sort(lower)[-k] - self.slack if len(lower) >= k else -np.inf
            for j in summary:
                self.whole[j, i] = dots[i, j] + norms[i] * far[j] + u * (norms[j] + far[j]) + self.slack >= self.least[i]
        # neighbouring cells side by side, packed into groups
        self.groups: dict[int, list[int]] = {}
        rest, at, held, group = set(reach), None, 0, -1
        while rest:
            at = min(rest) if at is None else min(rest, key=lambda j: (between[at, j], j))
            rest.remove(at)
            size = reach[at][1]
            if size > group_queries:
                pieces = -(-size // group_queries)
                self.groups[at] = list(range(group + 1, group + 1 + pieces))
                group, held = group + pieces, group_queries
                continue
            if group < 0 or held + size > group_queries:
                group, held = group + 1, 0
            held += size
            self.groups[at] = [group]
        self.n_groups = group + 1


def needed(cells: DataFrame, pivots: np.ndarray, bounds: Bounds) -> DataFrame:
    """grp, id, v, needs (a bit for each query cell that may need the vector): one row a vector and group."""
    cells_of = np.zeros((bounds.n_groups, len(pivots)), bool)
    for i, groups in bounds.groups.items():
        cells_of[groups, i] = True

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(lo, STEP_ROWS)
                x = _integers(part.column(1)).astype(float)
                most = x @ pivots.T + np.sqrt((x * x).sum(1))[:, None] * bounds.u + bounds.slack
                near = (most >= bounds.least) & bounds.whole[part.column(2).to_numpy()]
                for g in range(bounds.n_groups):
                    mine = near & cells_of[g]
                    some = np.flatnonzero(mine.any(1))
                    if len(some):
                        at = pa.array(some)
                        bits = [b.tobytes() for b in np.packbits(mine[some], axis=1)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), part.column(0).take(at), part.column(1).take(at), pa.array(bits, pa.binary())], ["grp", "id", "v", "needs"])

    return cells.select("id", "v", "cell").mapInArrow(work, "grp int, id long, v array<long>, needs binary")


def top_k(data: DataFrame, queries: DataFrame, k: int = K, n_pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, id, score: for each query (id, v) the k data rows (id, v) of the highest inner product."""
    plan = _plan(data, queries, k, n_pivots, group_queries)
    if plan is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    cells, asked, pivots, bounds = plan
    sent = needed(cells, pivots, bounds)
    n_blocks = parts_for(cells, BLOCK_BYTES)
    sent = sent.withColumns({"block": F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int"), "cell": F.lit(-1)})
    groups = F.create_map(*[F.lit(x) if c == 0 else F.array(*map(F.lit, x)) for i, g in bounds.groups.items() for c, x in enumerate((i, g))])
    mine = groups[F.col("cell")]
    posed = asked.select(F.get(mine, F.pmod(F.xxhash64("id"), F.size(mine)).cast("int")).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "cell", "id", "v", F.lit(None).cast("binary").alias("needs"))
    local = posed.unionByName(sent.select(*posed.columns)).groupBy("grp", "block").applyInArrow(_solve(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _plan(data: DataFrame, queries: DataFrame, k: int, n_pivots: int, group_queries: int):
    """Steps 1 to 3: cells of data and queries, pivots, bounds; None without data or queries."""
    data = materialise(data, "topk-data")
    chosen = data.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(n_pivots).collect()
    if not chosen:
        return None
    both = data.select("v").union(queries.select("v"))
    low, high = both.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError("vectors of unequal lengths")
    p = np.array([r[0] for r in chosen], float)
    cells = materialise(data.mapInArrow(_cells(p), _CELL_SCHEMA), "topk-cells")
    asked = materialise(queries.mapInArrow(_cells(p), _CELL_SCHEMA), "topk-queries")
    reach = {r[0]: (r[1], r[2]) for r in asked.groupBy("cell").agg(F.max("dist"), F.count("*")).collect()}
    if not reach:
        return None
    # the vectors that a bound counts may be the query's own
    k += data.groupBy("id").count().agg(F.max("count")).first()[0]
    summary = {r["cell"]: r for r in _least(cells, k).collect()}
    return cells, asked, p, Bounds(p, summary, reach, k, group_queries)


def _least(cells: DataFrame, k: int) -> DataFrame:
    """Per cell: far and its k least distances, found per part of the cell first."""
    salted = cells.select("cell", "dist", F.pmod(F.xxhash64("id", "v"), F.lit(64)).alias("salt"))
    parts = salted.withColumn("n", F.row_number().over(Window.partitionBy("cell", "salt").orderBy("dist")))
    kept = parts.groupBy("cell", "salt").agg(F.max("dist").alias("far"), F.array_sort(F.collect_list(F.when(F.col("n") <= k, F.col("dist")))).alias("d"))
    return kept.groupBy("cell").agg(F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("least"))


def _best(score: np.ndarray, d_ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row; ``d_ids`` ascend, so that equal scores stand by id."""
    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return some[np.argsort(-score[some], kind="stable")][:k]


def _solve(k: int):
    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        cell, ids, v = group.column("cell").to_numpy(), group.column("id").to_numpy(), _integers(group.column("v"))
        is_data = cell < 0
        d, d_ids = v[is_data], ids[is_data]
        bits = b"".join(group.column("needs").drop_null().to_pylist())
        needs = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(d), -1), axis=1).astype(bool) if len(d) else None
        out: list[tuple[np.ndarray, ...]] = []
        for c in np.unique(cell[~is_data]).tolist() if len(d) else ():
            at = np.flatnonzero(needs[:, c])
            near, near_ids = (d, d_ids) if len(at) == len(d) else (d[at], d_ids[at])
            q, q_ids = v[cell == c], ids[cell == c]
            step = max(1, (1 << 22) // max(1, len(near)))
            for lo in range(0, len(q) if len(near) else 0, step):
                for i, row in zip(q_ids[lo : lo + step].tolist(), products(q[lo : lo + step], near)):
                    # a query's own id is no candidate
                    other = np.flatnonzero(near_ids != i)
                    some = other[_best(row[other], near_ids[other], k)]
                    out.append((np.full(len(some), i), near_ids[some], row[some]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table({n: pa.array(c.tolist(), pa.int64()) for n, c in zip(("query_id", "id", "score"), columns)})

    return work


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = vectors(table(spark, sf_dir, "embeddings"))
    found = top_k(data, data.where("id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, d.vec_id as vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) as bigint) as score
  from v q, v d where q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""
