"""Readers, writers and memoised stages.  CSV comes in as text and is cast by the operators that know the meaning."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with a header, every column as text (no inference pass over the data)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(text_schema(columns)) if columns else reader.option("inferSchema", False)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, first: str | None = None, single: bool = False) -> None:
    """CSV with a header; ``first`` names the column that leads; ``single`` puts all rows through one task into one file."""
    if first:
        df = df.select(first, *[c for c in df.columns if c != first])
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def find_column(df: DataFrame, *names: str) -> str:
    """The first of ``names`` that the table has, upper or lower case being alike."""
    have = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in have:
            return have[name.lower()]
    raise KeyError(f"none of {names} in {df.columns}")


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def number(column: Column | str) -> Column:
    """Text to double; what is no number becomes null, and so does NaN."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def normals_long(df: DataFrame) -> DataFrame:
    """Climate normals, one row for each item and month; rows of the same item stay apart by item and detail."""
    return df.unpivot([df.columns[0], df.columns[1]], present(df, MONTHS), "month", "text").withColumn("value", number("text"))


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def materialize(spark: SparkSession, root: str, name: str, config: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """A stage that is computed once for each configuration: another configuration never meets this one's rows."""
    path = f"{root.rstrip('/')}/{name}-{fingerprint(config)}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


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


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows as a written table in the shared folder: what reads them several times does not compute them several times,
    and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
