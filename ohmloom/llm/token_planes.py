"""Token ids as a binary format of shuffled planes.

A shard holds whole documents in ascending order.  Its ids are cut into chunks of ``chunk_ids``; a chunk's little-endian
32-bit ids are transposed into byte planes (or bit planes), planes that are all zero are left out, every other plane is
compressed with zstandard by itself.  The chunk index (offset, number of ids, checksum, length of each plane) and the
document index stand at the end, so one chunk or one document can be read without the others.

Layout: ``OLBP`` | u8 version | u8 planes of an id (4: bytes, 32: bits) | u16 0 | planes of all chunks |
document index (zstd) | chunk index | tail ``<QQIIQQ4s>``: lengths of both indexes, chunk size, number of chunks,
documents and ids, ``OLBP``.

The files are binary cells of a Parquet table (part, shard, n_docs, n_ids, file), not files of a folder: any store that
Spark writes will do, Spark's commit makes the write atomic and a lost task is simply written again.

Defined results: a null or empty text is just the end id; null doc_ids come first; equal doc_ids keep a fixed order
(by text); an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, parts_for, shuffle_partitions, table
from .tokens import default_path, encoder

MAGIC = b"OLBP"
END_ID = 0
CHUNK_IDS = 1 << 16
SHARD_IDS = 1 << 22
PART_BYTES = 8 << 20
STEP_ROWS = 4096
LEVEL = 1
_TAIL = struct.Struct("<QQIIQQ4s")
_ENTRY = struct.Struct("<QII")


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """4 byte planes or 32 bit planes of little-endian 32-bit ids, the lowest first."""
    if bits:
        return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(32)]
    return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    if len(planes) == 4:
        out = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                out[:, k] = np.frombuffer(plane, np.uint8)
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        if plane is not None:
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return ids


def write_shard(doc_ids: list[int | None], every: np.ndarray, lengths: list[int], bits: bool = False, chunk_ids: int = CHUNK_IDS, level: int = LEVEL) -> bytes:
    """The file of a shard: the ids of all its documents, one after another, and how many each has."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    n_planes = 32 if bits else 4
    every = every.astype("<u4", copy=False)
    out, index, at = [MAGIC, bytes([1, n_planes, 0, 0])], [], 8
    for lo in range(0, len(every), chunk_ids):
        part = every[lo : lo + chunk_ids]
        planes = [press(p) if any_bit(p) else b"" for p in to_planes(part, bits)]
        index.append(_ENTRY.pack(at, len(part), zlib.crc32(part)) + struct.pack(f"<{n_planes}I", *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = press(named.tobytes() + np.array(lengths, "<u8").tobytes() + known.tobytes())
    chunks = b"".join(index)
    return b"".join([*out, docs, chunks, _TAIL.pack(len(docs), len(chunks), chunk_ids, len(index), len(doc_ids), len(every), MAGIC)])


def any_bit(plane: bytes) -> bool:
    return plane.count(0) != len(plane)


class Shard:
    """Reads a shard's file: documents, and ids by chunk or range."""

    def __init__(self, file: bytes):
        import zstandard

        self._file, self._open = file, zstandard.ZstdDecompressor().decompress
        docs, chunks, self.chunk_ids, n_chunks, n, self.n_ids, magic = _TAIL.unpack_from(file, len(file) - _TAIL.size)
        if magic != MAGIC or file[:4] != MAGIC or file[4] != 1:
            raise ValueError("not a file of this format")
        n_planes, at = file[5], len(file) - _TAIL.size - chunks
        raw = self._open(file[at - docs : at], max_output_size=17 * n + 1)
        named, known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 16 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(named, known)]
        self.starts = np.append(0, np.cumsum(np.frombuffer(raw, "<u8", n, 8 * n))).astype(np.int64)
        size = _ENTRY.size + 4 * n_planes
        self.index = [(*_ENTRY.unpack_from(file, at + i * size), struct.unpack_from(f"<{n_planes}I", file, at + i * size + _ENTRY.size)) for i in range(n_chunks)]

    def chunk(self, i: int) -> np.ndarray:
        at, n, check, lengths = self.index[i]
        bits, planes = len(lengths) == 32, []
        for k in lengths:
            planes.append(self._open(self._file[at : at + k], max_output_size=-(-n // 8) if bits else n) if k else None)
            at += k
        ids = from_planes(planes, n)
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError(f"chunk {i} is damaged")
        return ids

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first = lo // self.chunk_ids
        got = np.concatenate([self.chunk(i) for i in range(first, (hi - 1) // self.chunk_ids + 1)])
        return got[lo - first * self.chunk_ids : hi - first * self.chunk_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, offset in the shard, ids) of every document; chunks are decoded once, one or a document's at a time."""
        held, base, i = np.zeros(0, np.uint32), 0, 0
        for d, lo, hi in zip(self.doc_ids, self.starts[:-1].tolist(), self.starts[1:].tolist()):
            held, base = held[lo - base :], lo
            more = [held]
            have = len(held)
            while base + have < hi:
                more.append(self.chunk(i))
                have += len(more[-1])
                i += 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield d, lo, held[: hi - lo]


_FILES = "part int, shard int, n_docs long, n_ids long, file binary"
_FILE_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def write_files(documents: DataFrame, tokenizer_path: str | None = None, bits: bool = False, shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and write shards in ascending doc_id order; returns the table of files (read back)."""
    path = tokenizer_path or default_path()
    parts = max(shuffle_partitions(documents.sparkSession), parts_for(documents, PART_BYTES))

    def work(batches):
        from pyspark import TaskContext

        part, shard, names, ids, lengths, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def file():
            file = write_shard(names, np.concatenate(ids), lengths, bits)
            values = [pa.array([x], kind) for x, kind in zip((part, shard, len(names), held, file), _FILE_TYPES)]
            return pa.RecordBatch.from_arrays(values, ["part", "shard", "n_docs", "n_ids", "file"])

        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                some = batch.slice(lo, STEP_ROWS)
                got, counts = encoder(path).encode(some.column(1))
                ends = np.cumsum(counts)
                got, ends = np.insert(got, ends, end_id).astype("<u4", copy=False), ends + np.arange(1, len(ends) + 1)
                named, done = some.column(0).to_pylist(), 0
                while done < len(named):
                    # up to the document that fills the shard
                    base = int(ends[done - 1]) if done else 0
                    upto = min(len(named), int(np.searchsorted(ends, base + shard_ids - held)) + 1)
                    names += named[done:upto]
                    lengths += np.diff(ends[done:upto], prepend=base).tolist()
                    ids.append(got[base : int(ends[upto - 1])])
                    held += len(ids[-1])
                    done = upto
                    if held >= shard_ids:
                        yield file()
                        shard, names, ids, lengths, held = shard + 1, [], [], [], 0
        if names:
            yield file()

    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return materialise(ordered.mapInArrow(work, _FILES), "token-planes")


def read_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def work(batches):
        for batch in batches:
            for part, shard, file in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = [(d, lo, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))) for d, lo, ids in Shard(file).documents()]
                d, lo, n, c = zip(*rows)
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array([shard] * k, pa.int32()), *(pa.array(x, pa.int64()) for x in (d, lo, n, c))],
                    ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    docs = files.select("part", "shard", "file").mapInArrow(work, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row for each file: a few bytes for about 16 MB of ids
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return docs.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents").select("doc_id", "text")))
