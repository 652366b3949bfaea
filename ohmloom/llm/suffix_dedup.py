"""Exact substring dedup by prefix-free parsing, spread over blocks of documents and buckets of the dictionary.

Parsing.  A rolling hash of ``GRAM`` bytes is computed at every byte.  The trigger of a window of ``length`` bytes is its
gram of the least hash (the first of equal ones), so equal windows have equal triggers at equal offsets wherever they
stand.  A phrase is a maximal run of windows with one trigger; neighbouring phrases overlap by length - 1 bytes and no
phrase's suffix of ``length`` or more bytes is the prefix of another's other than as the same window: every window of the
corpus lies in exactly one phrase occurrence, and copies of it lie in phrases with the same trigger hash.

1. Triggers: each block of documents sends its distinct trigger hashes to buckets, with a mark where two of its documents
   share one.  A bucket answers one bit each: is this trigger known from two documents?  All other phrases are done.
2. Dictionary and parse: blocks send the distinct phrases of these triggers, each with the first document of its parse
   in the block.  A bucket unites equal phrases (the dictionary; the least document of the parse) and sorts the suffixes
   that begin a window, cut to ``length`` bytes: its suffix array.  Triggers with a single phrase need no sorting.
   Buckets being ranges of triggers, the suffix arrays of all buckets side by side are the corpus in the order of
   (bucket, window), and with the parse every class of equal windows gets its least document.
3. Blocks get back, per phrase, the least document of each of its windows (run-length coded), walk their parse once more
   and cover the bytes of windows whose least document is smaller than their own.

Text is shuffled once; the three passes reuse that exchange.  A block or bucket is bounded by the input's size over the
number of blocks; what a frequent passage adds to a bucket is one phrase a block at most, however often it occurs.

Defined results: a null text is empty and loses nothing; texts shorter than ``length`` lose nothing; rows of one doc_id
are one document and lose nothing to each other; a null doc_id comes after all others; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, fold64, materialise, parts_for, shuffle_partitions, table

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 3 << 20
#: Bytes hashed at a time: the arrays of one step stay in the processor's cache.
STEP = 1 << 17

_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_KEYS = fold64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hashes of the GRAM bytes from each byte on (GRAM a power of two), by doubling."""
    h, k, power = _KEYS[data], 1, _BASE
    while k < GRAM:
        h = h[:-k] * np.uint64(power) + h[k:]
        k, power = 2 * k, power * power & 0xFFFFFFFFFFFFFFFF
    return fold64(h)


def _least_in(h: np.ndarray, span: int) -> np.ndarray:
    k = 1
    while 2 * k <= span:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (span - k)], h[span - k :]) if span > k else h


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hash, first window, number of windows and text of each phrase, in text order.

    Two occurrences of one gram side by side may be the trigger of neighbouring windows in turn; their windows then make
    one phrase, which changes nothing: the runs are still those of equal trigger hashes.
    """
    span = length - GRAM + 1
    hashes, firsts, counts = [], [], []
    total = len(data)
    for lo in range(0, total - length + 1, STEP):
        part = data[lo : min(total, lo + STEP + length - 1)]
        least = _least_in(_gram_hashes(part), span)
        cut = np.ones(len(least), bool)
        cut[1:] = least[1:] != least[:-1]
        # windows of two texts are none; a text's first window starts a phrase
        heads = offsets[(offsets > lo) & (offsets < lo + len(least))] - lo
        cut[heads] = True
        at = np.flatnonzero(cut)
        hashes.append(least[at])
        firsts.append(at + lo)
        counts.append(np.diff(np.append(at, len(least))))
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    h, first, count = np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts)
    # a phrase cut by a step goes on in the next
    text = np.searchsorted(offsets, first, side="right") - 1
    goes_on = np.zeros(len(h), bool)
    goes_on[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) & (first[1:] == first[:-1] + count[:-1])
    heads = np.flatnonzero(~goes_on)
    count = np.add.reduceat(count, heads)
    h, first, text = h[heads], first[heads], text[heads]
    # drop windows that reach over the end of their text
    count = np.minimum(count, offsets[text + 1] - length + 1 - first)
    ok = count > 0
    # least hashes crowd at the low end; mixed again they spread evenly over the buckets
    return fold64(h[ok] * np.uint64(_BASE)), first[ok], count[ok], text[ok]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class _Block:
    """The phrases of a block of documents and the distinct triggers they have, in the order in which buckets see them."""

    def __init__(self, docs: pa.Table, n_buckets: int, length: int):
        # a shuffle delivers rows in any order; every pass must see the same one
        self.docs = docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc = np.array([_LAST if i is None else i for i in docs.column("doc_id").to_pylist()], np.int64)
        self.data, self.offsets = flat(docs.column("text"))
        self.h, self.first, self.count, self.text = phrases(self.data, self.offsets, length)
        self.triggers, self.of = np.unique(self.h, return_inverse=True)
        self.buckets = _bucket(self.triggers, n_buckets)
        self.edges = np.append(np.flatnonzero(np.diff(self.buckets, prepend=-1)), len(self.triggers))

    def shared(self) -> np.ndarray:
        """Triggers that two documents of the block have."""
        owner = self.doc[self.text]
        low = np.full(len(self.triggers), _LAST)
        high = np.full(len(self.triggers), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, owner)
        np.maximum.at(high, self.of, owner)
        return low < high

    def distinct(self, many: np.ndarray, length: int):
        """Distinct phrases of the triggers marked in ``many``: (trigger number, bytes) -> number, least document, and the
        phrase number of each occurrence (-1: not among them)."""
        number: dict[tuple[int, bytes], int] = {}
        least: list[int] = []
        of = np.full(len(self.h), -1, np.int64)
        raw = self.data.tobytes()
        at = np.flatnonzero(many[self.of])
        for i, t, a, n, d in zip(at.tolist(), self.of[at].tolist(), self.first[at].tolist(), self.count[at].tolist(), self.doc[self.text[at]].tolist()):
            key = (t, raw[a : a + n + length - 1])
            k = number.setdefault(key, len(number))
            if k == len(least):
                least.append(d)
            elif d < least[k]:
                least[k] = d
            of[i] = k
        return number, np.array(least, np.int64), of


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist()):
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(data, dtype, size, at))
        at += dtype.itemsize * size
    return out


_MAIL = "bucket int, blk int, kind int, data binary"


def _mail(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    b, k, kind, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "blk": pa.array(k, pa.int32()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


def _ask_triggers(n_buckets: int, length: int):
    def work(docs: pa.Table) -> pa.Table:
        block = _Block(docs, n_buckets, length)
        both, blk = block.shared(), docs.column("blk")[0].as_py()
        return _mail([(int(block.buckets[a]), blk, 0, _pack(block.triggers[a:b], both[a:b].astype(np.uint8))) for a, b in zip(block.edges[:-1], block.edges[1:])])

    return work


def _answer_triggers(mail: pa.Table) -> pa.Table:
    parts = [_unpack(x) for x in mail.column("data").to_pylist()]
    every, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    seen = np.bincount(at, minlength=len(every)) + np.bincount(at, np.concatenate([p[1] for p in parts]), len(every))
    many, rows, lo = seen > 1, [], 0
    bucket = mail.column("bucket")[0].as_py()
    for blk, p in zip(mail.column("blk").to_pylist(), parts):
        bits = many[at[lo : lo + len(p[0])]]
        rows.append((bucket, blk, 0, _pack(np.packbits(bits))))
        lo += len(p[0])
    return _mail(rows)


def _many(block: _Block, mail: pa.Table) -> np.ndarray:
    """The answers to a block's triggers, put together in its order."""
    many = np.zeros(len(block.triggers), bool)
    place = {int(block.buckets[a]): (a, b) for a, b in zip(block.edges[:-1], block.edges[1:])}
    for bucket, kind, data in zip(*(mail.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
        if kind == 0:
            a, b = place[bucket]
            many[a:b] = np.unpackbits(_unpack(data)[0], count=b - a).astype(bool)
    return many


def _ask_phrases(n_buckets: int, length: int):
    def work(docs: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs.num_rows or not mail.num_rows:
            return _mail([])
        block = _Block(docs, n_buckets, length)
        number, least, _ = block.distinct(_many(block, mail), length)
        blk, keys = docs.column("blk")[0].as_py(), list(number)
        owner = np.array([t for t, _ in keys], np.int64)
        bucket = block.buckets[owner] if len(keys) else owner
        order = np.argsort(bucket, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        rows = []
        for a, b in zip(edges[:-1], edges[1:]):
            some = order[a:b]
            texts = [keys[i][1] for i in some]
            rows.append((int(bucket[some[0]]), blk, 1, _pack(block.triggers[owner[some]], least[some], np.array([len(x) for x in texts], np.int32), np.frombuffer(b"".join(texts), np.uint8))))
        return _mail(rows)

    return work


def suffix_array(dictionary: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the dictionary's suffixes that begin at ``begins``, by their first ``length`` bytes, and where in that
    order a suffix differs from the one before."""
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(dictionary, length)[begins])
    order = np.argsort(windows.view(f"S{length}").ravel(), kind="stable")
    ranked = windows[order]
    differs = np.ones(len(order), bool)
    differs[1:] = (ranked[1:] != ranked[:-1]).any(1)
    return order, differs


def _answer_phrases(length: int):
    def work(mail: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in mail.column("data").to_pylist()]
        trigger, least, size, raw = (np.concatenate([p[i] for p in parts]) for i in range(4))
        ends = np.cumsum(size, dtype=np.int64)
        data = raw.tobytes()
        number: dict[tuple[int, bytes], int] = {}
        of = np.fromiter((number.setdefault((t, data[e - s : e]), len(number)) for t, s, e in zip(trigger.tolist(), size.tolist(), ends.tolist())), np.int64, len(size))
        n = len(number)
        first_doc = np.full(n, _LAST)
        np.minimum.at(first_doc, of, least)
        keys = list(number)
        sizes = np.array([len(x) for _, x in keys], np.int64)
        windows = sizes - length + 1
        starts = np.append(0, np.cumsum(windows))
        result = np.repeat(first_doc, windows)
        # triggers with several phrases: the suffix array of their part of the dictionary
        _, group, many = np.unique(np.array([t for t, _ in keys], np.uint64), return_inverse=True, return_counts=True)
        several = np.flatnonzero(many[group] > 1)
        step_from = 0
        several = several[np.argsort(group[several], kind="stable")]
        weight = np.cumsum(windows[several])
        while step_from < len(several):
            # whole trigger groups, about a million windows at a time
            upto = int(np.searchsorted(weight, (weight[step_from - 1] if step_from else 0) + (1 << 19), side="right"))
            upto = max(upto, step_from + 1)
            while upto < len(several) and group[several[upto]] == group[several[upto - 1]]:
                upto += 1
            some = several[step_from:upto]
            dictionary = np.frombuffer(b"".join(keys[i][1] for i in some), np.uint8)
            at = np.cumsum(sizes[some]) - sizes[some]
            begins = np.repeat(at - (np.cumsum(windows[some]) - windows[some]), windows[some]) + np.arange(windows[some].sum())
            target = np.repeat(starts[some] - (np.cumsum(windows[some]) - windows[some]), windows[some]) + np.arange(windows[some].sum())
            order, differs = suffix_array(dictionary, begins, length)
            heads = np.flatnonzero(differs)
            low = np.minimum.reduceat(result[target[order]], heads)
            result[target[order]] = np.repeat(low, np.diff(np.append(heads, len(order))))
            step_from = upto
        # run-length coding of each phrase's windows
        cut = np.ones(len(result), bool)
        cut[1:] = result[1:] != result[:-1]
        cut[starts[:-1]] = True
        runs = np.flatnonzero(cut)
        run_starts = np.searchsorted(runs, starts)
        lengths = np.diff(np.append(runs, len(result))).astype(np.int32)
        values = result[runs]
        rows, lo, bucket = [], 0, mail.column("bucket")[0].as_py()
        for blk, p in zip(mail.column("blk").to_pylist(), parts):
            mine = of[lo : lo + len(p[0])]
            lo += len(p[0])
            n_runs = run_starts[mine + 1] - run_starts[mine]
            at = np.repeat(run_starts[mine] - (np.cumsum(n_runs) - n_runs), n_runs) + np.arange(n_runs.sum())
            rows.append((bucket, blk, 1, _pack(n_runs.astype(np.int32), lengths[at], values[at])))
        return _mail(rows)

    return work


def _cover(n_buckets: int, length: int, finish):
    def work(docs: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return finish(docs, np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool))
        block = _Block(docs, n_buckets, length)
        gone = np.zeros(len(block.data), bool)
        second = [(b, x) for b, k, x in zip(*(mail.column(c).to_pylist() for c in ("bucket", "kind", "data"))) if k == 1]
        if second:
            number, least, of = block.distinct(_many(block, mail), length)
            owner = np.fromiter((t for t, _ in number), np.int64, len(number))
            order = np.argsort(block.buckets[owner], kind="stable")
            # answers in the order of the questions
            parts = [_unpack(x) for _, x in sorted(second)]
            n_runs, lengths, values = (np.concatenate([p[i] for p in parts]) for i in range(3))
            begin = np.empty(len(order) + 1, np.int64)
            begin[:-1] = np.cumsum(n_runs) - n_runs
            begin[-1] = len(lengths)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = np.flatnonzero(of >= 0)
            q = place[of[at]]
            runs = begin[q + 1] - begin[q]
            # every run of every occurrence: its windows lie from `lo` on
            index = np.repeat(begin[q] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            within = np.cumsum(lengths) - lengths
            lo = np.repeat(block.first[at], runs) + within[index] - np.repeat(within[begin[q]] if len(q) else begin[q], runs)
            hit = values[index] < np.repeat(block.doc[block.text[at]], runs)
            lo, hi = lo[hit], lo[hit] + lengths[index][hit] + length - 1
            step = np.zeros(len(block.data) + 1, np.int32)
            np.add.at(step, lo, 1)
            np.add.at(step, hi, -1)
            gone = np.cumsum(step[:-1]) > 0
        return finish(block.docs, block.data, block.offsets, gone)

    return work


def mark(documents: DataFrame, finish, schema: str, length: int = LENGTH) -> DataFrame:
    """Find repeated bytes and let ``finish(docs, data, offsets, gone)`` turn each block into rows of ``schema``.

    ``docs`` has doc_id, text and blk; ``gone`` marks the bytes of ``data`` that earlier documents hold too.
    """
    n = max(2 * shuffle_partitions(documents.sparkSession), parts_for(documents, BLOCK_BYTES))
    # identical rows may fall together: what is dealt are documents
    docs = documents.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("blk"))
    asked = docs.groupBy("blk").applyInArrow(_ask_triggers(n, length), _MAIL)
    known = materialise(asked.groupBy("bucket").applyInArrow(_answer_triggers, _MAIL), "suffix-triggers")
    sent = docs.groupBy("blk").cogroup(known.groupBy("blk")).applyInArrow(_ask_phrases(n, length), _MAIL)
    least = sent.groupBy("bucket").applyInArrow(_answer_phrases(length), _MAIL)
    return docs.groupBy("blk").cogroup(known.union(least).groupBy("blk")).applyInArrow(_cover(n, length, finish), schema)


def _digest(docs: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    n_removed, n_spans, digests = [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        g = gone[a:b]
        n_removed.append(int(g.sum()))
        n_spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
        digests.append(hashlib.sha256(data[a:b][~g].tobytes()).hexdigest())
    return pa.table({"doc_id": docs.column("doc_id") if docs.num_rows else pa.array([], pa.int64()), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def _spans(docs: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    kept, starts, ends = [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        g = gone[a:b]
        e = np.diff(g.astype(np.int8), prepend=0, append=0)
        starts.append(np.flatnonzero(e == 1).tolist())
        ends.append(np.flatnonzero(e == -1).tolist())
        kept.append(data[a:b][~g].tobytes())
    return pa.table({"doc_id": docs.column("doc_id") if docs.num_rows else pa.array([], pa.int64()), "kept": pa.array(kept, pa.binary()), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64()))})


def dedup_substrings(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (bytes), starts and ends of the removed byte spans."""
    return mark(documents, _spans, "doc_id long, kept binary, starts array<long>, ends array<long>", length)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
