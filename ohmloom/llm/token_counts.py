"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer) are additive, so a change to the corpus is a signed delta: an insert adds a
document's counts, a delete takes them away, a revision (new text, new tokenizer version) does both.  A batch of deltas
is summed by group and written in a folder of its own under its batch id; it counts from the moment Spark's committer has
put down its success mark.  A batch id that counts already is not applied again, and of two attempts at one batch the one
whose name comes first counts, so a retried, replayed or doubled batch changes nothing and no rename has to be atomic.

Totals are the newest complete base plus the batches it does not hold.  ``compact`` writes the next base, first the ids it
takes in, then their sums, whose success mark makes it the newest; only then is removed what it holds.  Stopped anywhere,
the totals stay the same and the next call cleans up.

Defined results: null source or lang are groups; a null text counts no tokens and no characters, but one document;
repeated rows count as often as they stand there; groups whose documents all went are left out; no batches give no rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .tokens import default_path, encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")


def count_words(documents: DataFrame, version: str = "words-1") -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens, n_chars of every row; tokens are runs of non-blank characters."""
    return documents.select(
        "source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
    )


def count_bpe(documents: DataFrame, version: str = "byte_bpe_50k-1", tokenizer_path: str | None = None) -> DataFrame:
    """The same with tokens of a byte-level BPE; a batch of rows is summed by group before it leaves Python."""
    path = tokenizer_path or default_path()

    def work(batches):
        for batch in batches:
            _, counts = encoder(path).encode(batch.column(2))
            chars = pc.fill_null(pc.utf8_length(batch.column(2)), 0).cast(pa.int64())
            rows = pa.table([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), chars], ["source", "lang", "t", "c"])
            got = rows.group_by(["source", "lang"]).aggregate([([], "count_all"), ("t", "sum"), ("c", "sum")])
            got = got.select(["source", "lang", "count_all", "t_sum", "c_sum"]).rename_columns(["source", "lang", *SUMS])
            yield from got.combine_chunks().to_batches()

    counted = documents.select("source", "lang", "text").mapInArrow(work, "source string, lang string, n_docs long, n_tokens long, n_chars long")
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), *SUMS)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, *((F.lit(sign) * F.col(c)).cast("long").alias(c) for c in SUMS))


def inserts(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


_KINDS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


class TokenRollup:
    """The batches under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str = "") -> list[str]:
        place = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _complete(self, folder: str, part: str = "") -> str | None:
        """The first attempt in a folder whose writing was finished."""
        return next((f"{folder}/{a}" for a in self._names(folder) if self._fs.exists(self._at(f"{folder}/{a}/{part}_SUCCESS"))), None)

    def _base(self) -> str | None:
        """The newest complete base."""
        numbers = sorted((int(n.removeprefix("base=")) for n in self._names() if n.startswith("base=")), reverse=True)
        return next((found for n in numbers if (found := self._complete(f"base={n}", "sums/"))), None)

    def _among(self, base: str | None, ids: list[str]) -> set[str]:
        """Those of ``ids`` that a base holds."""
        if base is None or not ids:
            return set()
        held = self.spark.read.schema("id string").json(f"{self.path}/{base}/ids")
        return {r[0] for r in held.where(F.col("id").isin(ids)).collect()}

    def _open(self, base: str | None) -> dict[str, str]:
        """Batches that count beside the base: as many as came since it was written."""
        found = {n.removeprefix("batch="): self._complete(n) for n in self._names() if n.startswith("batch=")}
        found = {i: place for i, place in found.items() if place}
        held = self._among(base, list(found))
        return {i: place for i, place in found.items() if i not in held}

    def applied(self, batch_id: str) -> bool:
        return bool(self._complete(f"batch={batch_id}") or self._among(self._base(), [batch_id]))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before."""
        if not batch_id or any(c in batch_id for c in "/=: "):
            raise ValueError("a batch id is a plain file name")
        if self.applied(batch_id):
            return False
        _summed(deltas).coalesce(1).write.parquet(f"{self.path}/batch={batch_id}/{uuid.uuid4().hex}")  # a row a group
        return True

    def _sums(self, base: str | None, batches: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in batches.values()] + ([f"{self.path}/{base}/sums"] if base else [])
        rows = self.spark.read.schema(_KINDS).parquet(*paths) if paths else self.spark.createDataFrame([], _KINDS)
        return _summed(rows)

    def totals(self) -> DataFrame:
        base = self._base()
        return self._sums(base, self._open(base)).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def compact(self) -> None:
        """Fold all batches into a new base; readers that began before may have to begin anew."""
        base = self._base()
        batches = self._open(base)
        if batches:
            number = int(base.split("/")[0].removeprefix("base=")) + 1 if base else 0
            place = f"base={number}/{uuid.uuid4().hex}"
            ids = self.spark.createDataFrame([(i,) for i in sorted(batches)], "id string")
            if base:
                ids = ids.union(self.spark.read.schema("id string").json(f"{self.path}/{base}/ids"))
            ids.write.json(f"{self.path}/{place}/ids")
            self._sums(base, batches).coalesce(1).write.parquet(f"{self.path}/{place}/sums")
            base = self._base()
        still = self._open(base)
        for n in self._names():
            old = n.startswith("base=") and (base is None or n != base.split("/")[0])
            done = n.startswith("batch=") and n.removeprefix("batch=") not in still and self._complete(n)
            if (old and base) or done:
                self._fs.delete(self._at(n), True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in as words, are revised to BPE tokens, and the revision is replayed."""
    documents = table(spark, sf_dir, "documents").select("source", "lang", "text")
    rollup = TokenRollup(spark, scratch(spark, "rollup"))
    rollup.commit("0001-insert", inserts(count_words(documents)))
    revision = revisions(count_words(documents), count_bpe(documents))
    rollup.commit("0002-revise", revision)
    rollup.commit("0002-revise", revision)
    return rollup.totals()
