"""What several operators need: shared storage, sizing, Arrow views of text, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for intermediate rows in the folder that executors share (``spark.checkpoint.dir``), removed when the
    session ends.  Where the setting is missing, a session on one machine gets a folder of its own; others are told."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='ohmloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    home = f"{root.rstrip('/')}/ohmloom-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(home)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return f"{home}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, a lost executor costs nothing.
    ``release``: the shuffled rows that led to it go as soon as it is written, not when the driver collects garbage."""
    path = scratch(df.sparkSession, name)
    with _released(df.sparkSession, release):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _released(spark: SparkSession, release: bool = True):
    """Shuffled rows of the queries inside go as soon as each has run."""
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan (file sizes for a scan); nothing is read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` bytes the input makes, from ``least`` to 2^20."""
    return max(least, min(1 << 20, -(-estimated_bytes(df) // each)))


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes: an identity of 128 bits that is never null."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and len+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


_held: dict = {}


def held(key, make):
    """What a Python worker keeps from task to task, made when it is first asked for.  It keeps one thing only: an operator's
    tables go when another operator of the same session needs its own, and their memory goes back to the system."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)
        _held[key] = make()
    return _held[key]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def fold64(x: np.ndarray) -> np.ndarray:
    """A mixing bijection of uint64 (multiply and xor-shift), in place."""
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


#: Bytes that separate words once A-Z are lower-cased; everything from 0x80 belongs to words.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8 bytes; a null has none."""
    return text.translate(WORD_TABLE).split() if text else []


_LOWER = np.frombuffer(WORD_TABLE, np.uint8)
_BASE = 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1
#: The first k of eight bytes read as a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and per text the offset of its first (len+1).

    Words are read eight bytes at a time, all words at once.
    """
    n = len(offsets) - 1
    low = np.append(_LOWER[data], np.full(8, 32, np.uint8))
    is_word = low != 32
    # a word ends at a separator or where its text ends
    before = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, is_word[: len(data) - 1]
        before[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    first = np.flatnonzero(is_word[: len(data)] & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1 : len(data)]
    cuts = offsets[1:-1]
    after[cuts[cuts > 0] - 1] = False
    size = np.flatnonzero(is_word[: len(data)] & ~after) + 1 - first
    eight = np.ndarray(len(data) + 1, "<u8", low.tobytes(), strides=(1,))
    out = (size.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    todo, at, left = np.arange(len(first)), first, size
    for _ in range(_LONG_WORD // 8):
        out[todo] = fold64((out[todo] ^ (eight[at] & _FIRST[np.minimum(left, 8)])) * np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        if not more.any():
            break
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    else:
        import hashlib

        for i in todo.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(low[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, a shorter text with words being one run; and len+1 offsets."""
    lengths = np.diff(starts)
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    out_starts = np.append(0, np.cumsum(counts))
    if not len(words):
        return np.zeros(0, np.uint64), out_starts
    mixed = words.copy()
    for _ in range(1, k):
        shifted = np.zeros_like(mixed)
        shifted[:-1] = mixed[1:]
        mixed = words + shifted * np.uint64(_BASE)
    index = np.repeat(starts[:-1] - out_starts[:-1], counts) + np.arange(out_starts[-1])
    out = mixed[index]
    for i in np.flatnonzero((lengths > 0) & (lengths < k)):
        h = 0
        for w in reversed(words[starts[i] : starts[i + 1]].tolist()):
            h = (w + h * _BASE) & _MASK
        out[out_starts[i]] = (h + int(lengths[i])) & _MASK
    return fold64(out), out_starts


def components(links: DataFrame, name: str, limit: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (id, class_id), class_id the smallest id of the component.

    Alternating large-star and small-star steps: every step is two grouped aggregations with map-side combine over a
    table in the shared folder; no component and no star is gathered anywhere.
    """
    edges = materialise(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-edges",
        release=True,
    )
    for _ in range(limit):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = materialise(small, f"{name}-step", release=True)
        roles = new.select(F.col("u").alias("id"), F.lit(1).alias("n"), F.lit(0).alias("heads")).union(new.select("v", F.lit(0), F.lit(1)))
        open_ends = roles.groupBy("id").agg(F.sum("n").alias("n"), F.max("heads").alias("heads")).where("n > 1 or (n = 1 and heads = 1)")
        edges = new
        # stars only: every u has one v and no v is a u
        with _released(links.sparkSession):
            settled = not open_ends.limit(1).count()
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct()
    )
