"""The table of stored results: Parquet, one folder per day, sorted by sender domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators.store import ID_PART, id_part


def stored_form(flat: DataFrame, stable_id: str | None = None, now: Column | None = None) -> DataFrame:
    """Add id, processed_at, created_at and the day. ``stable_id`` names a column whose hash is
    the id, so that a replay writes the same rows; without it ids are random."""
    at = F.current_timestamp() if now is None else now
    ident = F.uuid() if stable_id is None else F.sha2(F.col(stable_id).cast("string"), 256)
    return flat.withColumns({"id": ident, "processed_at": at, "created_at": at}).withColumn(
        "dt", F.to_date("processed_at"))


def append_results(stored: DataFrame, path: str, id_parts: int = 0) -> None:
    """Append; rows of a day are sorted by domain and time, so domain queries skip row groups.

    With ``id_parts`` a day's rows are dealt into so many folders by a hash of the id, and a look-up by id reads only
    one of them. Files are made per folder, those of a large one split, so that a write makes few small ones.
    """
    folders = ["dt"]
    if id_parts:
        folders.append(ID_PART)
        stored = stored.withColumn(ID_PART, id_part(F.col("id"), id_parts)).hint("rebalance", *folders)
    (
        stored.sortWithinPartitions(*folders, "sender_domain", "processed_at")
        .write.mode("append").partitionBy(*folders).parquet(path)
    )


def write_batch(stored: DataFrame, path: str, batch_id: int) -> None:
    """Write the results of one micro-batch; writing it again replaces it."""
    (
        stored.drop("batch").sortWithinPartitions("dt", "sender_domain", "processed_at")
        .write.mode("overwrite").partitionBy("dt").parquet(f"{path}/batch={batch_id}")
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quarantine(bad: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Keep unusable messages with the reason."""
    if batch_id is None:
        bad.write.mode("append").parquet(path)
    else:
        bad.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
