"""Line dedup, built from DataFrame functions only.

Every line gets a 128-bit key of its stripped, lower-cased form.  (key, document, position) rows are range-partitioned
by key and document, so that a key held by a third of all documents spreads over many partitions, and are sorted inside
each partition by key, document and position.  One streaming pass marks the first occurrence of a key in a document;
first occurrences are counted by key with a partial count in every partition before anything moves.  Keys that reach
``min_docs`` documents lose their lines: their occurrences become, per document, a compressed keep bitmap (run lengths,
kept and dropped in turn), never text.  ``apply_bitmaps`` cuts texts by these bitmaps.

Lines are exploded and hashed once, into a written table of keys.  Of n lines at most ``HOT_KEYS`` keys can have n / HOT_KEYS
documents or more: these are broadcast, however large the input, and the lines of all other keys, none of which fills a
task, meet their keys by a shuffle.

Defined results: a null or empty text is one empty line; a key of under ``min_chars`` code points is never dropped;
documents are told apart by doc_id (null is one document), rows by doc_id and text, so repeated rows give repeated,
equal rows; a text whose lines are all dropped becomes empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import key128, materialise, parts_for, shuffle_partitions, table

MIN_DOCS = 10
MIN_CHARS = 1
#: Blank characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\f\r"
PART_BYTES = 8 << 20
HOT_KEYS = 10_000

_LINES = "split(coalesce(text, ''), '\\n', -1)"


def _keyed(documents: DataFrame) -> DataFrame:
    a, b = key128("doc_id", F.coalesce("text", F.lit("")))
    return documents.withColumns({"r1": a, "r2": b})


def line_rows(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line that could be dropped: r1, r2 (row key), doc_id, pos, h1, h2 (line key)."""
    lines = _keyed(documents).select("r1", "r2", "doc_id", F.posexplode(F.expr(_LINES)).alias("pos", "line"))
    stripped = F.trim(F.col("line"), F.lit(BLANKS))
    key = F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = lines.select("r1", "r2", "doc_id", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = key128("key")
    return lines.select("r1", "r2", "doc_id", "pos", h1.alias("h1"), h2.alias("h2"))


def common_keys(lines: DataFrame, min_docs: int = MIN_DOCS, parts: int = 8) -> DataFrame:
    """Keys (h1, h2) found in at least ``min_docs`` documents, and n_docs."""
    ordered = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange(parts, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    in_doc = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    firsts = ordered.withColumn("n", F.row_number().over(in_doc)).where("n = 1")
    return firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _meet(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines whose key (h1, h2) is among ``keys``, a key of many lines in no single task."""
    is_hot = F.col("n_docs") >= lines.count() / HOT_KEYS
    hot = F.broadcast(keys.where(is_hot).select("h1", "h2", F.lit(True).alias("hot")))
    marked = lines.join(hot, ["h1", "h2"], "left")
    rest = marked.where("hot is null").join(keys.where(~is_hot).select("h1", "h2"), ["h1", "h2"])
    return marked.where("hot").unionByName(rest).select("r1", "r2", "pos")


#: Sorted dropped positions p to run lengths of kept and dropped lines in turn, the first may be 0.
_RUNS = """
concat(
  flatten(transform(starts, (s, i) -> array(if(i = 0, s, s - ends[i - 1] - 1), ends[i] - s + 1))),
  array(n_lines - 1 - element_at(ends, -1)))
"""
#: Run lengths back to one boolean for each line.
_KEEP = "flatten(transform(keep_runs, (n, i) -> array_repeat(i % 2 = 0, n)))"


def keep_bitmaps(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row key r1, r2 of a text that loses lines: n_dropped and keep_runs array<int> (kept, dropped, kept, ...)."""
    parts = max(shuffle_partitions(documents.sparkSession), parts_for(documents, PART_BYTES))
    lines = materialise(line_rows(documents, min_chars), "line-keys")
    keys = materialise(common_keys(lines, min_docs, parts), "line-common")
    dropped = _meet(lines.select("r1", "r2", "pos", "h1", "h2"), keys).groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    sizes = dropped.withColumn("starts", F.expr("filter(at, (p, i) -> i = 0 or at[i - 1] <> p - 1)")).withColumn(
        "ends", F.expr("filter(at, (p, i) -> i = size(at) - 1 or at[i + 1] <> p + 1)")
    )
    # the last, open run is completed when the number of lines is at hand
    return sizes.select("r1", "r2", F.size("at").cast("long").alias("n_dropped"), F.expr(_RUNS.replace("n_lines - 1 - element_at(ends, -1)", "0")).alias("keep_runs"))


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``documents`` with n_lines, n_dropped, keep_runs and kept (the text that stays)."""
    texts = _keyed(documents).withColumn("__lines", F.expr(_LINES)).withColumn("n_lines", F.size("__lines").cast("long"))
    texts = texts.drop("__lines").join(bitmaps, ["r1", "r2"], "left")
    rest = F.expr("cast(n_lines as int) - aggregate(keep_runs, 0, (a, n) -> a + n)")
    texts = texts.withColumn("keep_runs", F.when(F.col("keep_runs").isNull(), F.array(F.col("n_lines").cast("int"))).otherwise(F.concat(F.slice("keep_runs", 1, F.size("keep_runs") - 1), F.array(rest))))
    kept = F.when(F.col("n_dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.expr(f"array_join(zip_with({_LINES}, {_KEEP}, (line, keep) -> if(keep, line, null)), '\\n')"))
    return texts.withColumns({"kept": kept, "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long"))}).drop("r1", "r2")


def dedup_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    return apply_bitmaps(documents, keep_bitmaps(documents, min_docs, min_chars))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, unnest(l) as line, unnest(range(len(l))) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
common as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where c.k is not null) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.k is null), '')) as kept_sha256
from keyed left join common c on keyed.k = c.k group by doc_id
"""
