"""Run reports and evaluation of classifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig


def category_shares(results: DataFrame, category: str = "email_category") -> DataFrame:
    """Results per category and their share in percent. The window runs over the few category rows."""
    counts = results.groupBy(category).agg(F.count(F.lit(1)).alias("results"))
    total = F.sum("results").over(Window.partitionBy())
    return counts.withColumn("percent", F.round(F.col("results") * 100.0 / total, 1))


def run_summary(results: DataFrame, confidence: str = "confidence_score", seconds: str = "processing_time") -> DataFrame:
    """Mean, least and greatest confidence and processing time."""
    return results.agg(
        F.count(F.lit(1)).alias("results"),
        F.avg(confidence).alias("avg_confidence"), F.min(confidence).alias("min_confidence"),
        F.max(confidence).alias("max_confidence"),
        F.avg(seconds).alias("avg_time"), F.min(seconds).alias("min_time"), F.max(seconds).alias("max_time"),
    )


def high_confidence(results: DataFrame, config: EngineConfig = DEFAULT_CONFIG, confidence: str = "confidence_score") -> DataFrame:
    return results.where(F.col(confidence) > config.high_confidence)


def high_confidence_count(results: DataFrame, config: EngineConfig = DEFAULT_CONFIG, confidence: str = "confidence_score") -> DataFrame:
    return results.agg(
        F.count(F.when(F.col(confidence) > config.high_confidence, 1)).alias("high_confidence"),
        F.count(F.lit(1)).alias("results"),
    )


def accuracy_by_model(
    predictions: DataFrame, labels: DataFrame, key: str, config: EngineConfig = DEFAULT_CONFIG,
    accepted_only: bool = True,
) -> DataFrame:
    """Accuracy and mean confidence per model; by default only of models that are good enough.

    ``predictions`` has (key, model, predicted, confidence), ``labels`` has (key, expected).
    """
    right = F.when(F.col("predicted") == F.col("expected"), 1.0).otherwise(0.0)
    scored = predictions.join(labels, key).groupBy("model").agg(
        F.count(F.lit(1)).alias("messages"), F.avg(right).alias("accuracy"),
        F.avg("confidence").alias("avg_confidence"),
    )
    return scored.where(F.col("accuracy") >= config.min_accuracy) if accepted_only else scored


def confusion(predictions: DataFrame, labels: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of (expected, predicted), over everything or per ``by``, such as the model."""
    return predictions.join(labels, key).groupBy(*by, "expected", "predicted").agg(F.count(F.lit(1)).alias("messages"))


def class_precision(
    confusion_counts: DataFrame, classes: Sequence[str] = rules.CATEGORIES, by: Sequence[str] = (),
) -> DataFrame:
    """Precision and recall of each class, from the confusion counts."""
    n = F.col("messages")
    per_class = F.explode(F.array(*[F.lit(c) for c in classes])).alias("category")
    rows = confusion_counts.select(*by, per_class, "expected", "predicted", "messages")
    hit = (F.col("expected") == F.col("category")) & (F.col("predicted") == F.col("category"))
    counted = rows.groupBy(*by, "category").agg(
        F.sum(F.when(hit, n).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("predicted") == F.col("category"), n).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("expected") == F.col("category"), n).otherwise(0)).alias("expected"),
    )
    return counted.select(
        *by, "category", "hits", "predicted", "expected",
        F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).alias("precision"),
        F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")).alias("recall"),
    )


def rank_providers(providers: DataFrame) -> DataFrame:
    """Providers that succeeded, best first: higher confidence, then less time.

    One row per provider: (provider, success, category, confidence, processing_time).
    """
    order = Window.partitionBy().orderBy(
        F.coalesce("confidence", F.lit(0.0)).desc(), F.col("processing_time").asc_nulls_last(), "provider")
    return providers.where("success").withColumn("rank", F.row_number().over(order))


def providers_by_category(providers: DataFrame) -> DataFrame:
    """The sorted names of the successful providers behind each category."""
    names = F.array_sort(F.collect_set("provider"))
    return (
        providers.where("success")
        .groupBy(F.coalesce("category", F.lit("unknown")).alias("category"))
        .agg(F.array_join(names, ", ").alias("providers"), F.count_distinct("provider").alias("n"))
    )


def latency_check(timings: DataFrame, config: EngineConfig = DEFAULT_CONFIG, seconds: str = "processing_time", confidence: str = "confidence_score") -> DataFrame:
    """One row: how many break a limit, and whether the run passes."""
    slow = F.count(F.when(F.col(seconds) >= config.max_latency_sec, 1))
    bad = F.count(F.when(~F.coalesce(F.col(confidence).between(0.0, 1.0), F.lit(False)), 1))
    mean = F.avg(seconds)
    return timings.agg(
        F.count(F.lit(1)).alias("messages"), slow.alias("too_slow"), bad.alias("bad_confidence"),
        mean.alias("avg_time"),
        ((slow == 0) & (bad == 0) & (F.coalesce(mean, F.lit(0.0)) < config.mean_latency_sec)).alias("passed"),
    )
