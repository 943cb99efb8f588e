"""Queries on the table of stored results."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.schemas import STORED_SCORE


#: The folder of a result within its day, where results are dealt out by id.
ID_PART = "id_part"
#: Parts in which the rows of one group are ranked before they are ranked together.
PARTS = 64


def flatten_result(df: DataFrame) -> DataFrame:
    """Storage form of a processed message: empty lists for absent ones, "unknown" domain."""

    def values(name: str) -> Column:
        return F.coalesce(F.col("data")[name], F.array().cast("array<string>")).alias(name)

    entity, meta = F.col("business_entity"), F.col("metadata")
    rest = [c for c in df.columns if c not in ("business_entity", "data", "metadata", "confidence_score")]
    return df.select(
        *rest,
        entity["name"].alias("business_name"), entity["website"].alias("business_website"),
        entity["dpo_email"].alias("dpo_email"), entity["industry"].alias("business_industry"),
        entity["location"].alias("business_location"),
        values("email"), values("phone_number"), values("credit_card_number"),
        F.col("confidence_score").cast(STORED_SCORE).alias("confidence_score"),
        F.coalesce(meta["sender_domain"], F.lit("unknown")).alias("sender_domain"),
        meta["footer_text"].alias("footer_text"), meta["urls"].alias("urls"),
    )


def floats_to_decimal(df: DataFrame) -> DataFrame:
    """Every float or double column, also inside structs and arrays, as a decimal."""

    def changed(kind: str) -> str:
        return kind.replace("double", STORED_SCORE.simpleString()).replace("float", STORED_SCORE.simpleString())

    return df.select(*[
        F.col(f.name).cast(changed(f.dataType.simpleString())).alias(f.name)
        if changed(f.dataType.simpleString()) != f.dataType.simpleString() else F.col(f.name)
        for f in df.schema.fields
    ])


def id_part(ident: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(ident.cast("string")), F.lit(parts)).cast("int")


def get_result(results: DataFrame, key, id_col: str = "id", id_parts: int = 0) -> DataFrame:
    """The result of an id. ``id_parts`` is the number that the table was written with; only one folder a day is read then."""
    found = results.where(F.col(id_col) == key)
    return found.where(F.col(ID_PART) == id_part(F.lit(key), id_parts)) if id_parts else found


def newest_of_domain(
    results: DataFrame, domain: str, limit: int = 50, at: str = "processed_at", id_col: str = "id", day: str = "dt",
) -> DataFrame:
    """The newest results of a domain in a table with day folders, read from its last day backwards: one day, then as
    many again as were read, until the limit is full. The first and the last day come from the folders; no column is read for them."""
    first, last = results.agg(F.min(day), F.max(day)).first()
    own = results.where(F.col("sender_domain") == domain)
    if last is None:
        return own.limit(0)
    days = 1
    while True:
        start = last - timedelta(days=days - 1)
        rows = own.where(F.col(day) >= F.lit(start))
        if start <= first or rows.limit(limit).count() >= limit:
            return rows.orderBy(F.col(at).desc(), id_col).limit(limit)
        days *= 2


def _within(results: DataFrame, start, end, at: str) -> Column:
    """Inclusive bounds on a time, and on the day folders where the table has them."""
    cond = F.lit(True)
    by_day = "dt" in results.columns and at == "processed_at"
    if start is not None:
        low = F.lit(start).cast("timestamp")
        cond = cond & (F.col(at) >= low) & (F.col("dt") >= F.to_date(low) if by_day else F.lit(True))
    if end is not None:
        high = F.lit(end).cast("timestamp")
        cond = cond & (F.col(at) <= high) & (F.col("dt") <= F.to_date(high) if by_day else F.lit(True))
    return cond


def query_by_domain(
    results: DataFrame, domain: str, limit: int = 50, start=None, end=None, strict: bool = False,
    at: str = "processed_at", id_col: str = "id",
) -> DataFrame:
    """Newest results of a domain, with inclusive time bounds.

    The bounds apply before the limit; ``strict`` applies them to the newest ``limit`` rows.
    """
    rows, bounds = results.where(F.col("sender_domain") == domain), _within(results, start, end, at)
    newest = [F.col(at).desc(), F.col(id_col)]
    if strict:
        return rows.orderBy(*newest).limit(limit).where(bounds)
    return rows.where(bounds).orderBy(*newest).limit(limit)


def latest_per_domain(
    results: DataFrame, n: int, start=None, end=None, at: str = "processed_at", id_col: str = "id",
) -> DataFrame:
    """The newest n of every domain. Each task first keeps its own newest n per domain, so a
    domain with most of the rows sends few of them through the shuffle."""
    order = Window.partitionBy("sender_domain").orderBy(F.col(at).desc(), id_col)
    return (
        results.where(_within(results, start, end, at))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    )


def rounded_mean(c: str, digits: int = 3) -> Column:
    """Half-even rounding of a mean, on a decimal."""
    return F.coalesce(F.bround(F.avg(c).cast("decimal(28,12)"), digits).cast("double"), F.lit(0.0))


def result_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_results"), rounded_mean("confidence_score").alias("average_confidence"))


def category_distribution(results: DataFrame) -> DataFrame:
    return (
        results.groupBy(F.coalesce("email_category", F.lit("unknown")).alias("email_category"))
        .agg(F.count(F.lit(1)).alias("results"))
    )


def top_domains(results: DataFrame, n: int = 10) -> DataFrame:
    return (
        results.groupBy(F.coalesce("sender_domain", F.lit("unknown")).alias("sender_domain"))
        .agg(F.count(F.lit(1)).alias("results"))
        .orderBy(F.col("results").desc(), "sender_domain").limit(n)
    )


def result_stats(results: DataFrame, sample_limit: int | None = None, domains: int = 10) -> DataFrame:
    """Rows (section, name, value) of all statistics, from one scan: totals, categories and sender domains are
    grouping sets of one aggregation.

    Exact by default; ``sample_limit`` reads all but the number of results off the first rows only.
    """
    rows = results if sample_limit is None else results.limit(sample_limit)
    named = rows.select(
        F.coalesce("email_category", F.lit("unknown")).alias("category"),
        F.coalesce("sender_domain", F.lit("unknown")).alias("domain"), "confidence_score")
    category, domain = F.col("category"), F.col("domain")
    sets = named.groupingSets([[], [category], [domain]], category, domain).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).cast("double").alias("n"),
        rounded_mean("confidence_score").alias("mean"))
    # Without any row there is no grouping set of everything; one that counts nothing stands in for it.
    nothing = results.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("domain"),
        F.lit(3).cast("long").alias("set"), F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"))
    sets = sets.withColumn("set", F.col("set").cast("long")).unionByName(nothing)

    def line(section: str, name: Column, value: str) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"), F.col(value).alias("value"), F.col("n").alias("n"))

    lines = (
        F.when(F.col("set") == 3, F.array(line("total", F.lit("results"), "n"), line("mean", F.lit("confidence_score"), "mean")))
        .when(F.col("set") == 1, F.array(line("category", category, "n"))).otherwise(F.array(line("domain", domain, "n"))))
    most = F.when(F.col("section") == "domain", domains).when(F.col("section") == "category", F.lit(1 << 30)).otherwise(1)
    found = sets.select(F.explode(lines).alias("x")).select("x.*").withColumn(
        "part", F.pmod(F.xxhash64("name"), F.lit(PARTS)))
    for keys in (["section", "part"], ["section"]):  # in parts first, so that no task ranks all domains
        order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "name")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
    found = found.select("section", "name", "value")
    if sample_limit is None:
        return found
    counted = results.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("total").alias("section"), F.lit("results").alias("name"), "value")
    return counted.unionByName(found.where("section <> 'total'"))
