"""From raw documents to token files: five stages, each one operator of the training-data subpackage.

Every stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of ``documents``; the last returns the
index of the files it wrote.  ``run`` writes each stage's rows in the shared folder and reads them again for the next.

Defined results, for all stages: further columns of any names, those of the operators' own results included, go through
unchanged; columns are looked up by their exact names (doc_id, text, source); an empty table gives an empty table; a null
doc_id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmloom.llm import decontamination, mixing, near_dedup, quality, token_planes
from ohmloom.llm.common import materialise, table

#: A text goes if the classifier finds it rather bad than good.
REJECT_BELOW = 0.5


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by their place, beside doc_id, text and source: no name of an operator can clash."""
    places = [f"__c{i}" for i in range(len(docs.columns))]
    own = [F.col(places[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text", "source") if c in docs.columns]
    return docs.toDF(*places).select(*places, *own)


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _carried(docs: DataFrame) -> tuple[str, ...]:
    return tuple(f"__c{i}" for i in range(len(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier scores at REJECT_BELOW or more; a null or empty text has a score as well."""
    rows = _numbered(docs)
    model = quality.train(rows, table(spark, sf_dir, "labels"))
    scored = quality.score(rows, model, keep=_carried(docs))
    return _back(scored.where(F.col("score") >= REJECT_BELOW), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id; of rows that share a doc_id the one of the least
    text, by hash and then bytes (rows equal in both are told apart by nothing that the stage looks at; one of them stays)."""
    rows = _numbered(docs)
    gone = near_dedup.classes(rows).where("doc_id <> class_id").select("doc_id").distinct()
    kept = rows.join(gone, "doc_id", "left_anti")
    again = rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    twice = kept.join(again, "doc_id", "left_semi").withColumn("__first", F.struct(F.xxhash64("text"), F.coalesce("text", F.lit(""))))
    one = twice.groupBy("doc_id").agg(F.min_by(F.struct(*_carried(docs)), "__first").alias("__row")).select("__row.*")
    return _back(kept.join(again, "doc_id", "left_anti").select(*_carried(docs)).unionByName(one), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the contract's rule does not call contaminated; a null or wordless text stays."""
    found = decontamination.scan(_numbered(docs), table(spark, sf_dir, "benchmark"), keep=_carried(docs))
    return _back(found.where(f"not ({decontamination.CONTAMINATED})"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it: words taken over its words, rounded half up; the words of all copies
    come near each source's target, as roundings up and down balance over many documents.  A text without words takes
    none and goes."""
    mixed = mixing.mix(_numbered(docs))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).otherwise(0)
    return _back(mixed.withColumn("__times", F.explode(F.array_repeat(F.lit(1), times))), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns the index read back from them: doc_id, start, n_tokens, ids_crc32."""
    return token_planes.read_files(token_planes.write_files(_numbered(docs)))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{number}", release=True)
    return docs


#: Learned scores, sketches and BPE are beyond SQL; the tests hold every stage against a plain one.
ORACLE_SQL = None
