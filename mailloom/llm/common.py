"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/mailloom-{uuid.uuid4().hex}/{what}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, what: str) -> str:
    """Work df out once as Parquet in the shared folder; its path. Its shuffle files go at once, since nothing reads
    them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := new_path(df.sparkSession, what))
    finally:
        conf.set(CLEANUP, before)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, worked out once and read again: lineage ends here, and lost executors lose nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, what))


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def look_up(rows: DataFrame, answers: DataFrame, keys: list[str], slot: str = "slot") -> DataFrame:
    """rows with the columns of answers (one row per key), null where there is none.

    A hot key does no harm: it meets its answer once per slot of rows that holds it, and its rows then meet the
    answer within their slots. slot is a stored column of rows that deals them out evenly, such as the partition
    that a row was read from. Keys aren't null.
    """
    local = rows.select(slot, *keys).distinct().join(answers, keys, "left")
    return rows.join(local, [slot, *keys], "left")


def text_of(column: str | Column) -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_named(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose identifier and text are named, each once, with all their columns.

    named holds doc_id and digest (the text's SHA-256, null counting as empty), a row for each row of docs that is
    meant. Rows that repeat in both can't be told apart by these, so of them, and only there, duplicates are dropped.
    """
    named = named.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_rows"))
    full = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"),
                       F.unhex(F.sha2(text_of(docs[text_col]), 256)).alias("own"))  # apart from docs' own names
    full = full.join(named, full["id"].eqNullSafe(named["_id"]) & (full["own"] == named["_digest"]))
    again = full.filter("_rows > 1").dropDuplicates(["id", "own"])
    return full.filter("_rows = 1").unionByName(again).select("row.*")
