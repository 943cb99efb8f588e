"""Validation of raw messages and the report on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.domains import is_valid_email
from mailloom.functions.text import bind


def problem(raw: Column, required: Sequence[str] = rules.REQUIRED_KEYS) -> Column:
    """Why a raw JSON message is unusable; null for a good one.

    A key counts as given even when its value is null. ``from_email`` stands in for ``from``. A sender that is given
    must be an address.
    """

    def lacking(keys: Column) -> Column:
        named = F.transform(keys, lambda k: F.when(k == "from_email", F.lit("from")).otherwise(k))
        return F.array_except(F.array(*[F.lit(k) for k in required]), named)

    def reason(missing: Column) -> Column:
        return (
            F.when(missing.isNull(), F.lit("invalid JSON"))
            .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
            .when(~is_valid_email(sender), F.lit("invalid sender"))
        )

    sender = F.coalesce(F.get_json_object(raw, "$.from"), F.get_json_object(raw, "$.from_email"))

    return bind(lacking(F.json_object_keys(raw)), reason)


def with_problem(df: DataFrame, raw: str = "raw", required: Sequence[str] = rules.REQUIRED_KEYS) -> DataFrame:
    return df.withColumn("error", problem(F.col(raw), required))


def validate(df: DataFrame, raw: str = "raw", required: Sequence[str] = rules.REQUIRED_KEYS) -> tuple[DataFrame, DataFrame]:
    """(good, bad); bad rows carry the reason in ``error``."""
    checked = with_problem(df, raw, required)
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def parse_messages(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Fields of good messages in place of the raw text."""
    fields = F.from_json(
        raw, "`from` string, from_email string, subject string, html_content string, text_content string")
    rest = [c for c in df.columns if c != raw]
    return df.select(*rest, fields.alias("m")).select(
        *rest,
        F.coalesce("m.from", "m.from_email").alias("from_email"),
        "m.subject", "m.html_content", "m.text_content",
    )


def item_status(checked: DataFrame, key: str) -> DataFrame:
    """One line per message: queued or error, with the reason."""
    return checked.select(
        key,
        F.when(F.col("error").isNull(), F.lit("queued")).otherwise(F.lit("error")).alias("status"),
        "error",
    )


def ingest_report(checked: DataFrame) -> DataFrame:
    """Totals and the success rate in percent; one row, also for no input."""
    total, queued = F.count(F.lit(1)), F.count(F.when(F.col("error").isNull(), 1))
    return checked.agg(
        total.alias("total"), queued.alias("queued"), (total - queued).alias("errors"),
        F.when(total > 0, F.round(queued * 100.0 / total, 1)).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that went through, and rows for the quarantine table. A failure is a value in a
    row, so one bad message never fails a task; lost tasks are Spark's to retry."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
