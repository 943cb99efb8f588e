"""Joins and cut points that hold when one key has a large share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 0.001
HOT_ROWS = 100_000


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a table that has at most one row per key.

    Keys with more than ``hot_share`` of the left rows are at most 1 / hot_share, so their
    right rows can be broadcast; all other keys meet in an ordinary shuffle join.
    """
    total = left.count()
    least = max(hot_rows, int(total * hot_share))
    if total <= least:
        return left.join(right, key, "left")
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = [r[key] for r in counts.where(F.col("_n") > least).select(key).collect()]
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = left.where(~is_hot).join(right.where(~is_hot), key, "left")
    return spread.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a table that several later steps read, as Parquet in the shared folder, so that each reads the columns
    it needs. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/mailloom-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
