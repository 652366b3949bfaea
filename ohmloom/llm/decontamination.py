"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

A text is normalised to its words (A-Z lower-cased, cut at every separator).  The automaton reads numbers of the
benchmark's words, two letters each, so it has at most 26 nodes a window however long the words are; a word that no item
has breaks every match.  It holds every window of 13 consecutive item words (a shorter item is one window); a match's end
is a word's number, and word numbers give back byte spans of the original.

Every Python worker holds an automaton, so its size is bounded: items are packed into blocks of at most ``block_nodes``
nodes (about 40 bytes each), one automaton and one scan for each block.  One block (any usual benchmark) needs no shuffle
at all; more blocks send only hit texts' spans through a shuffle.

Defined results: a null or wordless text has no words, no hits and the digest of the empty string; a null or wordless
item has no window; items of equal text are all counted; repeated rows give repeated rows; an item_id of null is
ignored; other columns of ``documents`` are carried through by ``scan(..., keep=...)`` only when asked for, and may have
any names but those of the results.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, held, materialise, table, words_of

WINDOW = 13
BLOCK_NODES = 4_000_000


def blocks_of(items: Iterator[tuple[str, bytes]], window: int, block_nodes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items packed so that the automaton of a block has about ``block_nodes`` nodes at most (a larger item: a block)."""
    block, held = [], 0
    for item, text in items:
        n = len(words_of(text))
        cost = 2 * min(n, window) * max(1, n - window + 1)
        if block and held + cost > block_nodes:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += cost
    if block:
        yield block


#: Two letters that no word of an item has.
_UNKNOWN = "\ufffe\ufffe"


class Scanner:
    """The automaton over a block of items, built once for each process that uses it."""

    def __init__(self, block: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        # first letters and second letters differ, so that a match cannot begin inside a word
        self.codes: dict[bytes, str] = {}
        owners: dict[str, tuple[int, list[str]]] = {}
        for item, text in block:
            words = words_of(text)
            for w in words:
                if w not in self.codes:
                    self.codes[w] = chr(256 + len(self.codes) // 256) + chr(len(self.codes) % 256)
            line, k = "".join(map(self.codes.__getitem__, words)), min(window, len(words))
            for pattern in {line[2 * i : 2 * (i + k)] for i in range(len(words) - k + 1)} if words else ():
                owners.setdefault(pattern, (k, []))[1].append(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, value in owners.items():
            self.automaton.add_word(pattern, value)
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged [from, to) runs of hit words, items with occurring windows."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (n, owners) in self.automaton.iter("".join(map(self.codes.get, words, itertools.repeat(_UNKNOWN)))):
            items.update(owners)
            # matches come by their end; at one end the longest comes first, so only the last run can grow to the left
            upto = end // 2 + 1
            start = upto - n
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, upto))
        return len(words), runs, items


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as [from, to) byte offsets of the original text."""
    if not runs:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in runs]


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_nodes: int = BLOCK_NODES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``documents``: the ``keep`` columns, n_words, n_hit, item_ids (sorted), byte_starts, byte_ends.

    The benchmark is streamed to the driver block by block (its rows, never the corpus).
    """
    items = (
        (r[0], bytes(r[1]))
        for r in benchmark.where("item_id is not null and text is not null")
        .select(F.col("item_id").cast("string"), F.encode("text", "utf-8"))
        .distinct()
        .toLocalIterator()
    )
    blocks = blocks_of(items, window, block_nodes) if window else iter(())
    block, second = next(blocks, None), next(blocks, None)
    if block is None:
        return _no_items(documents, keep)
    if second is None:
        return _scan_block(documents, block, window, keep).selectExpr(*[f"`{c}`" for c in keep], "n_words", f"{_COUNT} as n_hit", "item_ids", "byte_starts", "byte_ends")
    return _many_blocks(documents, itertools.chain([block, second], blocks), window, keep)


_COUNT = "aggregate(__runs, 0L, (n, r) -> n + r.b - r.a)"


def _scan_block(documents: DataFrame, block: list[tuple[str, bytes]], window: int, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns, n_words, runs, item_ids, byte_starts, byte_ends by the automaton of one block."""
    schema = documents.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out_schema = f"{fields}, n_words long, __runs array<struct<a:int,b:int>>, item_ids array<string>, byte_starts array<long>, byte_ends array<long>"
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    shared = documents.sparkSession.sparkContext.broadcast(block)
    key = hashlib.sha256(repr((window, sorted(block))).encode()).digest()

    def work(batches):
        scanner = held(("scanner", key), lambda: Scanner(shared.value, window))
        for batch in batches:
            n_words, runs, ids, lo, hi = [], [], [], [], []
            for text in as_bytes(batch.column(batch.schema.get_field_index("__text"))):
                n, found, items = scanner.scan(text)
                spans = byte_spans(text, found) if found else []
                n_words.append(n)
                runs.append([{"a": a, "b": b} for a, b in found])
                ids.append(sorted(items))
                lo.append([a for a, _ in spans])
                hi.append([b for _, b in spans])
            arrays = [batch.column(i) for i in range(len(keep))] + [
                pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(ids, pa.list_(pa.string())),
                pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_words", "__runs", "item_ids", "byte_starts", "byte_ends"])

    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(work, out_schema)


def _no_items(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def work(batches):
        for batch in batches:
            n = [len(words_of(t)) for t in as_bytes(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], [*keep, "n_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    counted = documents.select(*keep, F.col("text").alias("__text")).mapInArrow(work, f"{fields}, n_words long")
    return counted.selectExpr("*", "0L as n_hit", "cast(array() as array<string>) as item_ids", "cast(array() as array<long>) as byte_starts", "cast(array() as array<long>) as byte_ends")


def _many_blocks(documents: DataFrame, blocks: Iterator[list[tuple[str, bytes]]], window: int, keep: tuple[str, ...]) -> DataFrame:
    """Unite what several automata found in the same row: rows are told apart by a number fixed in a written table, so
    null and repeated ids are answered as by one automaton."""
    columns = list(dict.fromkeys([*keep, "text"]))
    rows = materialise(documents.select(*columns, F.monotonically_increasing_id().alias("__row")), "decontamination-rows")
    one = None
    for block in blocks:
        hits = _scan_block(rows, block, window, ("__row",)).where("size(__runs) > 0").drop("n_words")
        one = hits if one is None else one.union(hits)
    grouped = materialise(one, "decontamination").groupBy("__row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("__runs"))).alias("__runs"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("byte_starts").alias("a"), F.col("byte_ends").alias("b"))))).alias("spans"),
    )
    merged = (
        "filter(aggregate({0}, cast(array() as array<struct<a:{1},b:{1}>>), (m, r) -> "
        "if(size(m) > 0 and element_at(m, -1).b >= r.a, "
        "concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, r.b)))), "
        "concat(m, array(named_struct('a', r.a, 'b', r.b))))), x -> true)"
    )
    found = grouped.withColumn("__runs", F.expr(merged.format("__runs", "int"))).withColumn("spans", F.expr(merged.format("spans", "bigint"))).selectExpr(
        "__row", f"{_COUNT} as hit", "item_ids as ids", "transform(spans, s -> s.a) as los", "transform(spans, s -> s.b) as his",
    )
    counted = _no_items(rows, (*keep, "__row")).select(*keep, "__row", "n_words")
    return counted.join(found, "__row", "left").selectExpr(
        *[f"`{c}`" for c in keep], "n_words", "coalesce(hit, 0L) as n_hit", "coalesce(ids, cast(array() as array<string>)) as item_ids",
        "coalesce(los, cast(array() as array<long>)) as byte_starts", "coalesce(his, cast(array() as array<long>)) as byte_ends",
    )


#: A text counts as contaminated if hit words are at least one in twenty.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "cast(size(item_ids) as long) as n_items",
        "sha2(array_join(item_ids, ','), 256) as items_sha256", f"{CONTAMINATED} as contaminated",
    )


SQL = r"""
with items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
pats as (
  select distinct item, least(13, len(w)) as k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as p
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from items where len(w) > 0)),
docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
grams as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as p
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from docs, (select distinct k from pats) where len(w) >= k)),
hits as (select g.doc_id, g.i, g.k, p.item from grams g join pats p on g.k = p.k and g.p = p.p),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from docs d left join words using (doc_id) left join found using (doc_id)
"""
