"""Near-duplicate documents by Order MinHash and banded alignment.

Signatures: a text's k-mers are its runs of five words (a shorter text is one), each labelled with the number of its
occurrence.  For each of ``SKETCHES`` hash functions the ``PICKED`` labelled k-mers of the least hashes are taken and kept
in text order; their combined hash is a bucket key.  Sharing a key takes the same k-mers in the same order, so the
chance follows edit similarity, not only the set.

Classes: texts of the same words are copies; the least doc_id stands for them.  In every bucket the
member that meets most others over all its buckets leads, ties to the least id (a grouped maximum, so a bucket of any
size is never gathered), and each member is aligned with it: most often that is the text the others were made from.  Buckets whose
members these links leave in several components are finished exactly: members of different components meet in blocks of
at most ``BLOCK`` against ``BLOCK``, where a lower bound of their edit distance (never above the true one; from bitmaps of
their words) leaves few to align.  So every pair that shares a key ends up linked, joined otherwise, or shown to be unlike.

A link: edit distance over words of at most 20 % of the longer text (similarity 0.8 or more), by a bit-parallel
alignment in the diagonal band of that width.  A class is a connected component of links; class_id is its least doc_id.

Defined results: rows of one doc_id are one document; a null doc_id has no class (null); texts without words are copies
only of equal texts; null texts are nobody's copy; ties cannot occur, doc_ids being ordered; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, components, flat, fold64, materialise, shingle_hashes, table, word_hashes

SHINGLE = 5
SKETCHES = 64
PICKED = 2
SIMILARITY = 0.8
BLOCK = 1024
LEAST_BITS = 1024
SEED = 11


def labelled(kmers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with the number of their occurrence in the same text."""
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    own = kmers ^ fold64((text + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    sorted_own = own[order]
    new = np.ones(len(own), bool)
    new[1:] = sorted_own[1:] != sorted_own[:-1]
    if new.all():  # as below, with the number 0: a label may not depend on the texts beside it
        return fold64(kmers.copy())
    first = np.flatnonzero(new)
    number = np.empty(len(own), np.uint64)
    number[order] = (np.arange(len(own)) - first[np.cumsum(new) - 1]).astype(np.uint64)
    return fold64(kmers + number * np.uint64(0xD6E8FEB86659FD93))


def order_min_hash(kmers: np.ndarray, starts: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED, seed: int = SEED) -> np.ndarray:
    """A (texts, sketches) array of keys; every text must have a k-mer.

    A sketch orders the labelled k-mers by an odd factor of its own (they are well mixed already).  The place in the text is
    kept in the low bits, so that one grouped minimum gives both the k-mer and where it stands.
    """
    label = labelled(kmers, starts)
    counts, heads = np.diff(starts), starts[:-1]
    bits = max(1, int(counts.max(initial=1) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    place = np.arange(len(label), dtype=np.uint64) - np.repeat(heads, counts).astype(np.uint64)
    seeds = fold64(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed)) | np.uint64(1)
    out = np.empty((len(counts), sketches), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    short = counts < picked
    for s in range(sketches):
        v = label * seeds[s]
        v &= ~low
        v |= place
        at = np.empty((picked, len(counts)), np.int64)
        for p in range(picked):
            least = np.minimum.reduceat(v, heads)
            at[p] = heads + np.minimum((least & low).astype(np.int64), counts - 1)  # all taken: any
            v[at[p]] = top
        # a text of fewer k-mers takes its first again
        at[:, short] = np.where(np.arange(picked)[:, None] < counts[short], at[:, short], at[0, short])
        at.sort(axis=0)
        key = np.full(len(counts), seeds[s])
        for p in range(picked):
            key = fold64((key ^ label[at[p]]) * np.uint64(0x9FB21C651E98DF25))
        out[:, s] = key
    return out


def word_bits(label: np.ndarray) -> np.ndarray:
    """A bitmap of a text's words, each labelled with the number of its occurrence, of the least power of two of bits
    from 16 a word.  A replaced word flips two bits at most, an added or dropped one flips one."""
    size = max(LEAST_BITS, 1 << (16 * len(label) - 1).bit_length()) if len(label) else LEAST_BITS
    on = np.zeros(size, np.uint8)
    on[(label & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little")


def signatures(documents: DataFrame) -> DataFrame:
    """id, n_words, w1, w2 (identity of the words; null for a null text), bits, keys."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, offsets = flat(part.column(1))
                words, starts = word_hashes(data, offsets)
                n_words = np.diff(starts)
                w1, w2 = [], []
                for i, raw in enumerate(as_bytes(part.column(1))):
                    if raw is None:
                        w1.append(None)
                        w2.append(None)
                        continue
                    what = b"w" + words[starts[i] : starts[i + 1]].tobytes() if n_words[i] else b"t" + raw
                    digest = hashlib.blake2b(what, digest_size=16).digest()
                    w1.append(int.from_bytes(digest[:8], "little", signed=True))
                    w2.append(int.from_bytes(digest[8:], "little", signed=True))
                has = np.flatnonzero(n_words)
                keys: list = [[] for _ in n_words]
                if len(has):
                    sub_starts = np.append(0, np.cumsum(n_words[has]))
                    kmers, at = shingle_hashes(words, sub_starts, SHINGLE)
                    for i, k in zip(has, order_min_hash(kmers, at).view(np.int64).tolist()):
                        keys[i] = k
                label = labelled(words, starts)
                bits = [word_bits(label[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words.astype(np.int32)), pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n_words", "w1", "w2", "bits", "keys"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(work, "id long, n_words int, w1 long, w2 long, bits binary, keys array<long>")


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger: the cells of the band |i - j| <= most, a column at a
    time, as bits of one number (vertical differences; Hyyrö's form of Myers' algorithm)."""
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < end_a and lo < end_b and a[lo] == b[lo]:
        lo += 1
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a -= 1
        end_b -= 1
    a, b = a[lo:end_a], b[lo:end_b]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    k = min(most, max(n, m))
    if k >= n:  # too short for a band: every cell is in it
        return _whole(a, b, most)
    return _in_band(a, b, k, most)


def _whole(a: list[int], b: list[int], most: int) -> int:
    """The same without a band: a column is one number of len(a) bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, dist = mask, 0, len(a)
    for y in b:
        match = where.get(y, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | (~(diagonal | up) & mask), diagonal & up
        dist += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & mask, left << 1 & mask
        up, down = left | (~(diagonal | right) & mask), right & diagonal & mask
    return min(dist, most + 1)


def _plain(a: list[int], b: list[int], most: int) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


def _bitmap(places: list[int], n: int) -> int:
    on = np.zeros(n, np.uint8)
    on[places] = 1
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def _in_band(a: list[int], b: list[int], k: int, most: int) -> int:
    n, m, width = len(a), len(b), 2 * k + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    # a bitmap of the whole text for the few frequent words only: the rest is put together inside the band
    many = max(32, n // 2000)
    where = {x: _bitmap(at, n) for x, at in places.items() if len(at) > many}
    up, down, dist = ((1 << (k + 1)) - 1) << k, 0, k
    for j in range(1, m + 1):
        x, shift = b[j - 1], j - k - 1
        if x in where:
            match = (where[x] >> shift if shift >= 0 else where[x] << -shift) & mask
        else:
            match = 0
            for i in places.get(x, ()):
                if shift <= i < shift + width:
                    match |= 1 << (i - shift)
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right = down | (~(diagonal | up) & mask)
        left = diagonal & up
        if j + k <= n:
            dist += not diagonal & top
        else:
            bit = 1 << (n - j + k)
            dist += bool(right & bit) - bool(left & bit)
        slid = diagonal >> 1
        up, down = left | (~(slid | right) & mask), slid & right
    return min(dist, most + 1)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two word-hash sequences are within the distance, by lengths, common words and the alignment."""
    most = allowed(max(len(a), len(b)), similarity)
    if abs(len(a) - len(b)) > most:
        return False
    common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    if max(len(a), len(b)) - common > most:  # no alignment keeps more words than they have in common
        return False
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def allowed(longer: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * longer + 1e-9)


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike.  Long sides travel once, b's words meet a's where b's rows are."""
    left = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")

    def work(batches):
        for batch in batches:
            wa, wb = (as_bytes(batch.column(i)) for i in (2, 3))
            keep = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(wa, wb)]
            got = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["a", "b"])

    return both.mapInArrow(work, "a long, b long").distinct()


def flips(a: np.ndarray, b: np.ndarray) -> int:
    """Bits that differ, the larger bitmap folded to the size of the smaller (which only hides some)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_or.reduce(a.reshape(-1, len(b)), 0)
    return int(np.bitwise_count(a ^ b).sum())


def _local_pairs(batches):
    """Rows sorted by (key, i, j): inside each, members of different components whose word counts allow a link."""
    held: list[pa.RecordBatch] = []

    def solve(rows: pa.Table):
        key = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
        ids, comp, side, n = (rows.column(c).to_numpy() for c in ("id", "comp", "side", "n_words"))
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        bits = [np.frombuffer(b, np.uint64) for b in as_bytes(rows.column("bits"))]
        new = np.ones(len(ids), bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        edges = np.append(np.flatnonzero(new), len(ids))
        out_a, out_b = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            one = key[1][lo] == key[2][lo]
            for x in range(lo, hi):
                # in one block: the rows behind; in two: the first side against the second
                rest = np.arange(x + 1, hi) if one else np.arange(lo, hi)[side[lo:hi] == 1] if side[x] == 0 else np.zeros(0, int)
                rest = rest[comp[rest] != comp[x]]
                most = ((1 - SIMILARITY) * np.maximum(n[rest], n[x]) + 1e-9).astype(int)
                rest = rest[np.abs(n[rest] - n[x]) <= most]
                if not len(rest):
                    continue
                # two texts meet in many buckets: only the first that both have decides
                same = keys[rest] == keys[x]
                rest = rest[keys[x][same.argmax(1)] == key[0][lo]]
                for r in rest:
                    if flips(bits[x], bits[r]) + abs(int(n[r]) - int(n[x])) <= 2 * allowed(int(max(n[r], n[x]))):
                        out_a.append(int(min(ids[x], ids[r])))
                        out_b.append(int(max(ids[x], ids[r])))
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = tuple(batch.column(batch.schema.get_field_index(c)) for c in ("key", "i", "j"))
        changed = np.zeros(batch.num_rows, bool)
        for c in key:
            v = c.to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in key)
        cuts = np.flatnonzero(changed)
        if held and first != last:
            yield solve(pa.Table.from_batches(held))
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield solve(pa.Table.from_batches(held))
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
        last = tuple(c[-1].as_py() for c in key)
    if held:
        yield solve(pa.Table.from_batches(held))


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id of every row; other columns of ``documents`` are not used."""
    sig = materialise(signatures(documents), "near-signatures", release=True)
    named = sig.where("id is not null and w1 is not null")
    groups = named.groupBy("w1", "w2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = materialise(named.select("id", "w1", "w2").join(groups.where("n > 1"), ["w1", "w2"]).select("id", "rep").distinct(), "near-copies", release=True)
    later = copies.where("id <> rep").select("id").distinct()
    nodes = named.where("n_words > 0").join(later, "id", "left_anti")
    # a doc_id with several texts may be a copy with one of them: its other texts are linked through their own groups
    members = nodes.select("id", F.explode("keys").alias("key"))
    # most keys are known from one document only and go no further than a count
    counted = materialise(members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "n"), "near-counted", release=True)
    busy = materialise(members.join(counted, "key").distinct(), "near-busy", release=True)
    # who meets most others over all its buckets is the likeliest centre of a group: one order of leaders for all buckets
    weighed = busy.join(busy.groupBy("id").agg(F.sum("n").alias("weight")), "id")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("last"))).alias("top")).select("key", (-F.col("top.last")).alias("leader"))
    shared = materialise(busy.join(leaders, "key"), "near-shared", release=True)
    stars = shared.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    words = materialise(_word_table(documents, shared.select("id").distinct()), "near-words", release=True)
    links = materialise(_verified(stars, words), "near-links", release=True)
    first = materialise(components(links, "near"), "near-first", release=True)

    # what shares a bucket and is still apart
    apart = shared.select("key", "id", "n").join(first, "id", "left").select("key", "id", F.coalesce("class_id", "id").alias("comp"))
    parts = apart.groupBy("key", "comp").agg(F.count("*").alias("n"))
    spread = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    # the largest component's members are joined already: they meet the rest only, the rest meets all
    few, many = (F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int") for c in (F.col("n") - F.col("main.n"), F.col("main.n")))
    rows = apart.select("key", "id", "comp").join(spread.select("key", F.col("main.comp").alias("main"), few.alias("few"), many.alias("many")), "key")
    hashed = F.xxhash64("id")
    in_main = F.col("comp") == F.col("main")
    own = F.when(in_main, F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int")
    others = F.when(in_main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "comp")
    # a doc_id with several texts stands there with those that have the key
    rows = rows.join(nodes.select("id", "n_words", "bits", "keys"), "id").where(F.array_contains("keys", F.col("key")))
    met = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(_local_pairs, "a long, b long").distinct()
    more = _verified(met.join(links, ["a", "b"], "left_anti"), words)
    known = links.union(materialise(more, "near-more", release=True)).union(copies.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found = materialise(components(known, "near-all"), "near-classes", release=True)
    ids = documents.select(F.col("doc_id").cast("long").alias("id"))
    return ids.join(found, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def _word_table(documents: DataFrame, ids: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                words, starts = word_hashes(*flat(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in np.split((words >> np.uint64(32)).astype(np.uint32), starts[1:-1])], pa.binary())], ["id", "words"])

    return documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi").mapInArrow(work, "id long, words binary")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"))
