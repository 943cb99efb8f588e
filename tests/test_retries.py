"""Messages that fail once, twice and for good, and a restart in between."""

import time

from pyspark.sql import functions as F

from mailloom.streaming import retries


def fails(batch, _number):
    """Message n fails n times."""
    return batch.withColumn("error", F.when(F.col("attempt") <= F.col("raw").cast("int"), F.concat(F.lit("try "), "attempt")))


def test_failures_come_again_and_a_restart_loses_none(spark, tmp_path):
    work, queue = str(tmp_path / "work"), str(tmp_path / "queue")
    rows = spark.createDataFrame([(f"m{i}", str(i % 6)) for i in range(30)], "source_file string, raw string")
    rows.where("source_file < 'm2'").coalesce(1).write.mode("append").parquet(queue)

    def start(pause):
        new = spark.readStream.schema("source_file string, raw string").parquet(queue)
        return retries.with_retries(new, fails, work, pause=pause, interval="100 milliseconds")

    first = start(2.0)
    end = time.monotonic() + 120
    while not (tmp_path / "work" / "attempts" / "batch=0" / "_SUCCESS").exists() and time.monotonic() < end:
        time.sleep(0.1)
    first.stop()  # most failures are now held, or on their way to be
    assert not retries.waiting(spark, work).isEmpty()
    rows.where("source_file >= 'm2'").coalesce(1).write.mode("append").parquet(queue)
    retries.finish(start(1.0), work, patience=200)
    got = {(r["source_file"], r["attempt"], r["error"]) for r in retries.attempts(spark, work).collect()}
    want = {(f"m{i}", a, f"try {a}" if a <= i % 6 else None) for i in range(30) for a in range(1, min(4, i % 6 + 1) + 1)}
    assert got == want and retries.attempts(spark, work).count() == len(want)
    dead = retries.dead_letters(spark, work).collect()
    assert sorted(r["source_file"] for r in dead) == sorted(f"m{i}" for i in range(30) if i % 6 > 3)
    assert {r["error"] for r in dead} == {"try 4"}
