"""The vector index: Parquet deltas, one per micro-batch, in numbered generations.

Readers see the deltas of the newest published generation below a batch number, so a batch
always sees the index as of its start, and a replayed batch replaces its own delta. Deleting
and compacting write a new generation and publish it by a row in the manifest afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from mailloom.operators.similarity import delete_ids
from mailloom.schemas import INDEX_ENTRY


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("generation int, published timestamp").parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            self._only_missing(error)
            return None

    @staticmethod
    def _only_missing(error: AnalysisException) -> None:
        """A path that isn't there is an empty index; anything else is an error."""
        if error.getCondition() != "PATH_NOT_FOUND":
            raise error

    def _current(self) -> int:
        manifest = self._manifest()
        newest = None if manifest is None else manifest.agg(F.max("generation").alias("g")).first()["g"]
        return 0 if newest is None else newest

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation={generation}"

    def _rows(self) -> DataFrame:
        """All entries of the newest generation, with the batch that wrote them."""
        folder = self._folder(self._current())
        try:
            rows = self.spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
        except AnalysisException as error:
            self._only_missing(error)
            return self.spark.createDataFrame([], INDEX_ENTRY).withColumn("batch", F.lit(0).cast("long"))
        return rows.select(*INDEX_ENTRY.fieldNames(), F.col("batch").cast("long").alias("batch"))

    def read(self, before_batch: int | None = None) -> DataFrame:
        """All entries, or those written before a batch."""
        rows = self._rows()
        if before_batch is not None:
            rows = rows.where(F.col("batch") < before_batch)
        return rows.select(*INDEX_ENTRY.fieldNames())

    def append(self, entries: DataFrame, batch_id: int) -> None:
        """Add the entries of one batch; doing so again replaces them, also after compacting or deleting."""
        rows = entries.select(*[F.col(f.name).cast(f.dataType) for f in INDEX_ENTRY.fields])
        rows.write.mode("overwrite").parquet(f"{self._folder(self._current())}/batch={batch_id}")

    def _publish(self, rows: DataFrame) -> None:
        """A new generation, in which each batch's entries are still that batch's. Nothing may append meanwhile."""
        generation = self._current() + 1
        rows.hint("rebalance", "batch").write.mode("overwrite").partitionBy("batch").parquet(self._folder(generation))
        row = self.spark.range(1).select(F.lit(generation).alias("generation"), F.current_timestamp().alias("published"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def delete(self, ids: DataFrame) -> None:
        self._publish(delete_ids(self._rows(), ids))

    def compact(self) -> None:
        self._publish(self._rows())

    def reset(self) -> None:
        self._publish(self._rows().where(F.lit(False)))
