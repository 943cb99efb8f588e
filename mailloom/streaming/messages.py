"""Messages as a stream: each micro-batch is processed against the index as of its start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig
from mailloom.operators.ingest import parse_messages, split_failures, with_problem
from mailloom.operators.skew import cut_lineage
from mailloom.operators.store import flatten_result
from mailloom.plans.messages import Hooks, PageTable, index_entries, process_messages
from mailloom.sources.index import VectorIndex
from mailloom.sources.messages import message_id, raw_message_stream
from mailloom.sources.results import quarantine, stored_form, write_batch


def start(
    batches: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    writer = batches.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def message_handler(
    work: str, *, config: EngineConfig = DEFAULT_CONFIG, hooks: Hooks = Hooks(), pages: PageTable | None = None,
    metric: str = "sql2", required=rules.REQUIRED_KEYS, dedup_distance: float | None = None,
) -> Callable[[DataFrame, int], None]:
    """Handler of one micro-batch of (source_file, raw).

    Everything it writes is keyed by the batch number and replaced on a replay: quarantine,
    results, and the confident results that join the index for later batches.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        index = VectorIndex(batch.sparkSession, f"{work}/index")
        good, bad = split_failures(with_problem(batch, required=required))
        quarantine(bad, f"{work}/quarantine", batch_id)
        messages = message_id(parse_messages(good))
        processed = cut_lineage(process_messages(
            messages, index.read(before_batch=batch_id), pages=pages, config=config, hooks=hooks, metric=metric))
        stored = stored_form(flatten_result(processed.drop("document", "embedding", "match_distance")), "email_id")
        write_batch(stored, f"{work}/results", batch_id)
        index.append(index_entries(processed, config, dedup_distance), batch_id)

    return handle


def process_stream(rows: DataFrame, work: str, available_now: bool = True, **options) -> StreamingQuery:
    """Process a stream of whole JSON messages (source_file, raw) from any source, such as a
    message queue; ``source_file`` is whatever names a message."""
    return start(rows.select("source_file", "raw"), message_handler(work, **options), f"{work}/stream", available_now)


def ingest_stream(
    spark: SparkSession, path: str, work: str, files_per_trigger: int | None = None,
    available_now: bool = True, **options,
) -> StreamingQuery:
    """Process a folder of message files as they arrive."""
    return process_stream(raw_message_stream(spark, path, files_per_trigger), work, available_now, **options)
