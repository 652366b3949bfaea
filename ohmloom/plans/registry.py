"""Names, queries and SQL that the modules of this package register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL for a second engine."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def out(df: DataFrame, *stamps: str) -> DataFrame:
    """Instants as wall clock, so that engines with and without zones agree."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label", (F.col("label") == 0).cast("int").alias("y"))


def tall(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", "y", F.posexplode("x").alias("feature", "value")).withColumn("feature", F.col("feature").cast("string"))


TALL_SQL = "tall as (select vec_id as id, cast(label = 0 as int) as y, cast(unnest(range(len(embedding))) as varchar) as feature, cast(unnest(embedding) as double) as value from embeddings)"
