"""Mixing sources to target weights by Sainte-Laguë apportionment, built from DataFrame functions only.

Targets: the sources share ``total`` of all words by weight; a source's target stops at ``cap`` times its words and the
excess is reshared by weight (a water level, found in closed form over the per-source table).

Apportionment: the mix has a fixed number of blocks of ``block_words`` words, its targets' sum over the block size, rounded.
They go to the sources by the highest quotients target / (2k - 1), k = 1, 2, ...  A source is split by a seeded hash into
shards of about ``shard_words`` words, numbered in a tree of at most ``FAN`` children a node; each node's blocks go to its
children by the highest quotients words / (2k - 1), so every shard has an integer quota.  Of a node with S children, H
blocks and V votes only the last quotients are ranked: with the divisor V / (H + S) the roundings add up to H at least,
with V / (H - S) to H at most, so a child's seats lie between v / V * (H - S) and v / V * (H + S), rounded; what lies below is
its own without ranking.  About five quotients a child are ordered, by node: a hot source is many nodes.

Selection: in a shard, documents stand in a seeded order and their words are numbered; the blocks are consecutive
numbers.  The shard's quota is taken as whole passes and then consecutive blocks from a seeded first block on, around
the end.  ``taken`` counts the words of a document that lie in taken blocks, each pass counted.

Defined results: a null text has size 0 and takes 0; a null source is a source, the last; sources without words have
target 0; of equal quotients the first source, or shard, wins; a shard never gives more than ``cap`` times its words, so a
source of a few words may miss its target by less than a block a shard; rows repeated in full share one place in the order and take the same;
an empty table gives no rows.  Columns of ``documents`` called size, source_size, target or taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shuffle_partitions, table

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
CAP = 2
SHARD_WORDS = 1 << 14
BLOCK_WORDS = 32
FAN = 1024
SEED = 42

#: The same in Spark SQL and DuckDB: 32 bits of an md5 as a number.
_SPARK_HASH = "cast(conv(substr(md5({0}), {1}, 8), 16, 10) as bigint)"
_DUCK_HASH = "cast(('0x' || substr(md5({0}), {1}, 8)) as bigint)"


def sizes(documents: DataFrame) -> DataFrame:
    """``documents`` with size: the number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """Per source: source_size and target.  One row for each source; only these rows are ordered in one place."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    index = f"array({', '.join(f'{float(w)}D' for w in weights)})"
    per = per.withColumn("__n", F.row_number().over(by_name)).withColumn("w", F.expr(f"{index}[(__n - 1) % {len(weights)}]"))
    # sources in the order in which a rising water level fills them; the level at which the k-th is full leaves the rest open
    rise = Window.orderBy(F.expr("source_size / w"), "__n")
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "all": F.sum("source_size").over(Window.partitionBy()),
            "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "open": F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.expr(f"({total}D * all - {cap}D * full) / open"))
    # full is what comes before the first source that its share does not fill
    per = per.withColumn("fills", F.expr(f"level * w >= {cap}D * source_size"))
    per = per.withColumn("first_open", F.min(F.when(~F.col("fills"), F.struct(F.expr("source_size / w"), F.col("__n"), F.col("level")))).over(Window.partitionBy()))
    target = F.expr(f"case when first_open is null then {cap}D * source_size else least({cap}D * source_size, first_open.level * w) end")
    return per.select("source", "source_size", target.cast("double").alias("target"))


def apportion(votes: DataFrame, node: tuple[str, ...], child: str) -> DataFrame:
    """``votes`` (node..., child, votes, blocks: those of the whole node) with seats: the child's blocks by the highest
    quotients votes / (2k - 1), of equal ones to the child that comes first.  A node is ordered in one place."""
    whole, part = Window.partitionBy(*node), Window.partitionBy(*node).orderBy(F.desc("quotient"), child)
    counted = votes.withColumns({"all_votes": F.sum("votes").over(whole), "children": F.count("*").over(whole)})
    share = F.try_divide(F.col("votes").cast("double"), F.col("all_votes").cast("double"))
    slack = F.col("children") + 1
    # rounded outwards by one more, for what doubles lose
    sure = F.greatest(F.lit(0), F.floor(share * (F.col("blocks") - slack) - 1.5)).cast("long")
    most = F.greatest(F.lit(0), F.ceil(share * (F.col("blocks") + slack) + 1.5)).cast("long")
    counted = counted.withColumn("sure", F.when(F.col("votes") > 0, sure).otherwise(0)).withColumn("most", F.when(F.col("votes") > 0, most).otherwise(0))
    counted = counted.withColumn("open", F.col("blocks") - F.sum("sure").over(whole))
    ranked = counted.select(*node, child, "sure", "votes", "open", F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("most")))).alias("k"))
    ranked = ranked.withColumn("quotient", F.col("votes") / (2 * F.col("k") - 1)).withColumn("place", F.row_number().over(part))
    won = F.count_if(F.col("k").isNotNull() & (F.col("place") <= F.col("open")))
    return ranked.groupBy(*node, child).agg((F.first("sure") + won).alias("seats"))


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total: float = TOTAL,
    cap: float = CAP,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    text: bool = True,
    fan: int = FAN,
) -> DataFrame:
    """``documents`` (without the text, if it is not asked for) with size, source_size, target, taken."""
    columns = [c for c in documents.columns if c not in ("size", "source_size", "target", "taken") and (text or c != "text")]
    mark = f"concat('{seed}:', coalesce(cast(doc_id as string), ''))"
    sized = sizes(documents).select(
        *columns, "size", F.coalesce("source", F.lit("")).alias("__k"), F.col("source").isNull().alias("__null"),
        F.expr(_SPARK_HASH.format(mark, 1)).alias("__shard"), F.expr(_SPARK_HASH.format(mark, 9)).alias("__order"), F.xxhash64("text").alias("__h"),
    )
    sized = materialise(sized, "mixing-sizes")
    per = materialise(targets(sized, weights, total, cap), "mixing-targets")
    named = per.select(F.coalesce("source", F.lit("")).alias("__k"), F.col("source").isNull().alias("__null"), "source_size", "target")
    # one row for each source
    blocks = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words + 0.5).cast("long")
    by_name = Window.partitionBy(F.lit(0)).orderBy("__null", F.encode("__k", "utf-8"))
    votes = named.select(F.lit(0).alias("mix"), F.row_number().over(by_name).alias("__n"), F.col("target").alias("votes"), blocks.alias("blocks"), "__k", "__null")
    seats = apportion(votes, ("mix",), "__n").join(votes.select("__n", "__k", "__null"), "__n").select("__k", "__null", "seats")
    known = named.join(seats, ["__k", "__null"]).withColumn("__shards", F.greatest(F.lit(1), F.expr(f"source_size div {shard_words}")))
    known = materialise(known, "mixing-sources")

    rows = sized.join(known.drop("seats"), ["__k", "__null"]).withColumn("__shard", F.col("__shard") % F.col("__shards"))
    shards = rows.groupBy("__k", "__null", "__shard").agg(F.sum("size").alias("votes"))
    shards = materialise(shards, "mixing-shards")
    quotas = _down_the_tree(shards, known, fan).withColumn("__quota", F.col("seats") * block_words).drop("seats")
    quotas = quotas.join(shards.withColumnRenamed("votes", "__shard_size"), ["__k", "__null", "__shard"])
    # by shard: else the join's partitioning by source would serve the windows and keep a hot source in one task
    rows = rows.repartition(shuffle_partitions(documents.sparkSession), "__k", "__null", "__shard").join(quotas, ["__k", "__null", "__shard"])
    # rows of one doc_id are told apart by what they hold, so that the order and the result are the same in every run
    in_shard = Window.partitionBy("__k", "__null", "__shard").orderBy("__order", "doc_id", "__h")
    rows = rows.withColumn("__behind", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    return _take(rows, cap, block_words, seed).select(*columns, "size", "source_size", "target", "taken")


def _down_the_tree(shards: DataFrame, sources: DataFrame, fan: int) -> DataFrame:
    """__k, __null, __shard, seats: a source's blocks go down a tree whose leaves are its shards."""
    most = sources.agg(F.max("__shards")).first()[0] or 1
    levels = 1
    while fan**levels < most:
        levels += 1
    keys = ("__k", "__null")
    nodes = shards.join(sources.select(*keys, "seats"), list(keys)).withColumnRenamed("seats", "blocks")
    seats = None
    for level in range(1, levels + 1):
        # at level l a node is a shard's number without its last digits
        here, above = (F.expr(f"__shard div {fan ** (levels - at)}") for at in (level, level - 1))
        votes = nodes.groupBy(*keys, above.alias("__above"), here.alias("__here")).agg(F.sum("votes").alias("votes"), F.first("blocks").alias("blocks"))
        if seats is not None:
            votes = votes.drop("blocks").join(seats.select(*keys, F.col("__here").alias("__above"), F.col("seats").alias("blocks")), [*keys, "__above"])
        seats = apportion(votes, (*keys, "__above"), "__here")
        if level < levels:
            seats = materialise(seats, "mixing-seats")
    return seats.select(*keys, F.col("__here").alias("__shard"), "seats")


def _take(rows: DataFrame, cap: float, block: int, seed: int) -> DataFrame:
    """taken, from __quota, __shard_size and __behind (words of the shard up to and with the document)."""
    n = F.greatest(F.col("__shard_size"), F.lit(1))
    quota = F.least("__quota", (F.lit(cap) * F.col("__shard_size")).cast("long"))
    rows = rows.withColumns({"__passes": F.floor(quota / n).cast("long"), "__rest": quota % n})
    pick = F.expr(_SPARK_HASH.format(f"concat('{seed}/', __k, '/', cast(__shard as string))", 1))
    rows = rows.withColumn("__first", pick % F.ceil(n / block) * block)
    # words from..to of the shard are the document's; first..first+rest (around the end) are taken once more
    lo, hi, first, rest = F.col("__behind") - F.col("size"), F.col("__behind"), F.col("__first"), F.col("__rest")
    ahead = F.greatest(F.lit(0), F.least(hi, first + rest) - F.greatest(lo, first))
    around = F.greatest(F.lit(0), F.least(hi, first + rest - n) - lo)
    return rows.withColumn("taken", (F.col("__passes") * F.col("size") + ahead + around).cast("long"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), text=False).select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    """Every quotient is ranked, and a document's words are counted below its ends, apart from the query's formulas."""
    mark = f"'{SEED}:' || coalesce(cast(doc_id as varchar), '')"
    pick = _DUCK_HASH.format(f"'{SEED}/' || k || '/' || cast(shard as varchar)", 1)
    weights = ", ".join(f"cast({w} as double)" for w in WEIGHTS)
    return rf"""
with sized as (
  select doc_id, source, coalesce(source, '') as k, source is null as nul, text,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
named as (
  select k, nul, source_size, row_number() over (order by nul, k) as n from (
    select k, nul, cast(sum(size) as bigint) as source_size from sized group by k, nul)),
weighed as (select *, ([{weights}])[cast((n - 1) % {len(WEIGHTS)} as int) + 1] as w from named),
levels as (
  select *, (cast({TOTAL} as double) * sum(source_size) over () - cast({CAP} as double) * coalesce(sum(source_size) over (order by source_size / w, n rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by source_size / w, n rows between unbounded preceding and 1 preceding), 0)) as level from weighed),
opened as (select level as water from levels where not level * w >= cast({CAP} as double) * source_size order by source_size / w, n limit 1),
per as (
  select k, nul, n, source_size, least(cast({CAP} as double) * source_size, coalesce((select water from opened) * w, cast({CAP} as double) * source_size)) as target from levels),
source_quotients as (select k, nul, n, target / (2 * unnest(range(1, cast(ceil(target / {BLOCK_WORDS}) as bigint) + 100)) - 1) as quotient from per where target > 0),
source_ranks as (select *, row_number() over (order by quotient desc, n) as place from source_quotients),
given as (select k, nul, count(*) as blocks from source_ranks where place <= (select floor(sum(target) / {BLOCK_WORDS} + 0.5) from per) group by k, nul),
sharded as (
  select s.*, source_size, target, {_DUCK_HASH.format(mark, 1)} % greatest(1, source_size // {SHARD_WORDS}) as shard
  from sized s join per p on s.k = p.k and s.nul = p.nul),
shards as (select k, nul, shard, cast(sum(size) as bigint) as n from sharded group by k, nul, shard),
shard_quotients as (select k, nul, shard, cast(n as double) / (2 * unnest(range(1, cast({CAP + 1} * n // {BLOCK_WORDS} as bigint) + 100)) - 1) as quotient from shards where n > 0),
shard_ranks as (select *, row_number() over (partition by k, nul order by quotient desc, shard) as place from shard_quotients),
quotas as (select r.k, r.nul, shard, count(*) * {BLOCK_WORDS} as quota from shard_ranks r join given g on r.k = g.k and r.nul = g.nul where place <= blocks group by r.k, r.nul, shard),
plans as (
  select s.k, s.nul, s.shard, n, least(coalesce(quota, 0), {CAP} * n) // greatest(n, 1) as passes, least(coalesce(quota, 0), {CAP} * n) % greatest(n, 1) as rest,
    {pick.replace("|| k ||", "|| s.k ||").replace("(shard as", "(s.shard as")} % greatest(1, cast(ceil(n / {BLOCK_WORDS}.0) as bigint)) * {BLOCK_WORDS} as head
  from shards s left join quotas q on s.k = q.k and s.nul = q.nul and s.shard = q.shard),
placed as (
  select doc_id, size, source_size, target, p.*, cast(sum(size) over (partition by d.k, d.nul, d.shard order by {_DUCK_HASH.format(mark, 9)}, doc_id rows between unbounded preceding and current row) as bigint) as behind
  from sharded d join plans p on d.k = p.k and d.nul = p.nul and d.shard = p.shard),
counted as (
  select *, passes * behind + least(greatest(behind - head, 0), rest) + least(behind, greatest(head + rest - n, 0)) as upto,
    passes * (behind - size) + least(greatest(behind - size - head, 0), rest) + least(behind - size, greatest(head + rest - n, 0)) as before from placed)
select doc_id, size, source_size, target, cast(upto - before as bigint) as taken from counted
"""


SQL = _sql()
