"""Failed messages tried again: held as state with a timer, given out after a pause, at last among the dead letters.

One query reads new messages and the failures that it writes itself. New messages are tried in the batch they come in.
A failure goes into a stateful operator, keyed by a bucket of messages, which keeps it until its bucket's timer fires and
then gives it out for its next try. Python is called, and a timer set, once per bucket and batch, not per message. State, timers and offsets live in the checkpoint, so a restart loses no message and forgets
no pause; what a batch writes is keyed by its number and replaced when it is replayed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tries of a message after its first, and the seconds between them.
RETRIES, PAUSE = 3, 60.0
#: Buckets that failures are held in, by the hash of their names. A checkpoint is bound to their number.
BUCKETS = 512
MESSAGE = "source_file string, raw string, attempt int"


class Hold(StatefulProcessor):
    """Keeps failed messages of a bucket until their pause is over. A message that comes again meanwhile is kept beside."""

    def __init__(self, pause: float):
        self.pause = int(pause * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "source_file string, raw string, attempt int, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentProcessingTimeInMs() + self.pause
        for part in rows:
            names = part["source_file"], part["raw"], part["attempt"]
            self.held.appendList([(name, raw, int(attempt), due) for name, raw, attempt in zip(*names)])
        self.handle.registerTimer(due)
        yield self.out([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = list(self.held.get())
        rest = [r for r in rows if r[3] > now]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        yield self.out([r for r in rows if r[3] <= now])

    @staticmethod
    def out(rows) -> pd.DataFrame:
        return pd.DataFrame(
            [(r[0], r[1], r[2] + 1) for r in rows], columns=["source_file", "raw", "attempt"]).astype({"attempt": "int32"})

    def close(self) -> None:
        pass


def with_retries(
    new: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], work: str, retries: int = RETRIES, pause: float = PAUSE,
    interval: str = "1 second",
) -> StreamingQuery:
    """Start the query over a stream of (source_file, raw), where source_file names a message.

    ``attempt(batch, number)`` tries a batch of (source_file, raw, attempt) and returns it with the column ``error``, null
    where the message went through; storing results is its own affair. Below ``work``: ``attempts`` has each try with
    its error, ``dead`` the messages that failed 1 + ``retries`` times, ``failures`` those on their way back.
    """
    spark = new.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # timers need it
    spark.createDataFrame([], MESSAGE).write.mode("append").parquet(f"{work}/failures")  # a folder to read from
    failed = spark.readStream.schema(f"{MESSAGE}, batch long").option("recursiveFileLookup", True).parquet(f"{work}/failures")
    bucket = F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).alias("bucket")
    again = failed.select("source_file", "raw", "attempt", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Hold(pause), outputStructType=MESSAGE, outputMode="Append", timeMode="ProcessingTime")
    both = new.select("source_file", "raw", F.lit(1).alias("attempt")).unionByName(again)

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/given/batch={number}")  # what is tried is settled before it is tried
        tried = attempt(spark.read.schema(MESSAGE).parquet(f"{work}/given/batch={number}"), number)
        tried.select("source_file", "raw", "attempt", "error").write.mode("overwrite").parquet(f"{work}/attempts/batch={number}")
        tried = spark.read.schema(f"{MESSAGE}, error string").parquet(f"{work}/attempts/batch={number}")
        bad = tried.where(F.col("error").isNotNull())
        bad.where(F.col("attempt") > retries).drop("attempt").write.mode("overwrite").parquet(f"{work}/dead/batch={number}")
        bad.where(F.col("attempt") <= retries).drop("error").write.mode("overwrite").parquet(f"{work}/failures/batch={number}")

    writer = both.writeStream.foreachBatch(handle).option("checkpointLocation", f"{work}/progress")
    return writer.trigger(processingTime=interval).start()


def attempts(spark: SparkSession, work: str) -> DataFrame:
    """Every try: (source_file, raw, attempt, error)."""
    return spark.read.schema(f"{MESSAGE}, error string").option("recursiveFileLookup", True).parquet(f"{work}/attempts")


def dead_letters(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.schema("source_file string, raw string, error string").option("recursiveFileLookup", True).parquet(f"{work}/dead")


def waiting(spark: SparkSession, work: str, retries: int = RETRIES) -> DataFrame:
    """(source_file, attempt) of failures whose next try is still to come."""
    done = attempts(spark, work).groupBy("source_file", "attempt").agg(F.count("error").alias("failed"), F.count("*").alias("tries"))
    following = done.select("source_file", (F.col("attempt") - 1).alias("attempt"), F.col("tries").alias("again"))
    return done.where((F.col("failed") > 0) & (F.col("attempt") <= retries)).join(
        following, ["source_file", "attempt"], "left").where(F.coalesce("again", F.lit(0)) < F.col("failed")).select("source_file", "attempt")


def finish(query: StreamingQuery, work: str, retries: int = RETRIES, patience: float = 600.0) -> None:
    """Let the query run until all messages that have come are through or dead, then stop it."""
    end, spark, seen = time.monotonic() + patience, SparkSession.active(), -1
    try:
        while time.monotonic() < end:
            last = query.lastProgress
            if query.exception() is not None:
                raise query.exception()
            # A batch without input, after which none waits, is the end: what timers give out is tried in their batch.
            if last is not None and last["batchId"] > seen and last["numInputRows"] == 0:
                seen = last["batchId"]
                if waiting(spark, work, retries).isEmpty():
                    return
            time.sleep(0.1)
        raise TimeoutError("messages are still waiting to be tried again")
    finally:
        query.stop()
