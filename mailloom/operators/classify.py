"""Categories by keyword rules or by a model the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from mailloom import rules
from mailloom.functions import domains, links
from mailloom.functions.text import bind
from mailloom.operators.skew import cut_lineage, lookup_join
from mailloom.schemas import EXTRACTED, MODEL_REPLY

#: Times that a prompt is asked by itself after its batch has failed.
ATTEMPTS = 3
#: Times that a prompt is asked in all, over all runs that keep their replies.
MOST_ATTEMPTS = 12
REPLIES = "_key string, reply string, attempts int"
Keywords = Sequence[tuple[str, Sequence[str]]]

DEFAULT_PROMPT = (
    "Assign the message to one of the categories {categories}, name the organisation behind it, "
    "and answer with one JSON object with the fields email_category, business_entity "
    "(name, website, industry, location, dpo_email), data (email, phone_number, "
    "credit_card_number) and confidence_score from 0 to 1."
)


def classify_rules(
    content: Column, table: Keywords = rules.CATEGORY_KEYWORDS, default: str = rules.DEFAULT_CATEGORY,
    whole_word: bool = False,
) -> Column:
    """First category one of whose keywords occurs; compiled into one expression."""

    def chosen(lower: Column) -> Column:
        result = F
        for category, words in table:
            if whole_word:
                quoted = "|".join(rf"\Q{w}\E" for w in words)
                hit = lower.rlike(rf"(?U)\b(?:{quoted})\b")
            else:
                hit = reduce(lambda acc, w: acc | lower.contains(w), words[1:], lower.contains(words[0]))
            result = result.when(hit, F.lit(category))
        return F.lit(default) if result is F else result.otherwise(F.lit(default))

    return bind(F.lower(content), chosen)


def no_data() -> Column:
    return F.lit(None).cast(EXTRACTED)


def fallback_result(
    content: Column, sender_domain: Column, urls: Column, table: Keywords = rules.CATEGORY_KEYWORDS,
) -> Column:
    """struct<email_category, business_entity, data, confidence_score> without any model."""
    broken = content.isNull() | sender_domain.isNull()
    name = F.when(broken, F.lit("Unknown")).otherwise(domains.company_from_domain(sender_domain))
    website = F.when(~broken, F.try_element_at(urls, F.lit(1)))
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.when(broken, F.lit(rules.DEFAULT_CATEGORY)).otherwise(classify_rules(content, table)).alias("email_category"),
        F.struct(
            name.alias("name"), website.alias("website"), nothing.alias("dpo_email"),
            nothing.alias("industry"), nothing.alias("location"),
        ).alias("business_entity"),
        no_data().alias("data"),
        F.when(broken, F.lit(0.1)).otherwise(F.lit(0.3)).alias("confidence_score"),
    )


def prompt(content: Column, sender_domain: Column, footer: Column, urls: Column, task: str = DEFAULT_PROMPT) -> Column:
    head = task.format(categories=", ".join(rules.CATEGORIES))
    return F.concat(
        F.lit(head + "\n\nMessage:\n"), F.coalesce(content, F.lit("")),
        F.lit("\n\nSender domain: "), F.coalesce(sender_domain, F.lit("unknown")),
        F.lit("\nFooter: "), F.when(footer != "", footer).otherwise(F.lit("No footer")),
        F.lit("\nURLs: "), F.when(F.size(urls) > 0, F.array_join(urls, ", ")).otherwise(F.lit("No URLs")),
    )


def parse_reply(reply: Column) -> Column:
    """The reply as a struct, or null where it is no JSON or not a valid record."""

    def checked(record: Column) -> Column:
        entity, score = record["business_entity"], record["confidence_score"]
        website, dpo = entity["website"], entity["dpo_email"]
        good = (
            record["email_category"].isin(*rules.CATEGORIES)
            & entity["name"].isNotNull() & record["data"].isNotNull() & score.between(0.0, 1.0)
            & (website.isNull() | (links.is_absolute(website) & (links.url_host(website) != "")))
            & (dpo.isNull() | domains.is_valid_email(dpo))
        )
        return F.when(good, record)

    return bind(F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), MODEL_REPLY), checked)


def kept_replies(spark: SparkSession, path: str) -> DataFrame:
    """(_key, reply, attempts): what earlier runs were answered, one row per prompt digest. Of several runs that asked
    the same, a reply counts before none, then the later attempt."""
    try:
        rows = spark.read.schema(REPLIES).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], REPLIES)
    return rows.groupBy("_key").agg(
        F.max_by("reply", F.struct(F.col("reply").isNotNull(), "attempts")).alias("reply"), F.max("attempts").alias("attempts"))


def call_model(
    df: DataFrame, prompt_col: str, reply_col: str, model: Callable[[pd.Series], pd.Series], kept: str | None = None,
    most_attempts: int = MOST_ATTEMPTS,
) -> DataFrame:
    """Add the model's reply. Equal prompts are asked once, and the replies are stored before they are joined.

    Where a batch fails, its prompts are asked one by one, each up to ``ATTEMPTS`` times; one that still fails has a
    null reply, and so hits no other. ``kept`` names a table of replies by prompt digest that outlives the run: what it
    has isn't asked again, what is asked is added to it, and a prompt that failed is asked again by later runs until
    it has been tried ``most_attempts`` times in all.
    """

    def ask(prompts: pd.Series) -> list:
        found = list(model(prompts))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} replies to {len(prompts)} prompts")
        return found

    def one(prompts: pd.Series):
        for _ in range(ATTEMPTS):
            try:
                return ask(prompts)[0]
            except Exception:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch["_prompt"]
            try:
                replies, tries = ask(prompts), 1
            except Exception:
                replies, tries = [one(prompts.iloc[i: i + 1]) for i in range(len(prompts))], 1 + ATTEMPTS
            yield pd.DataFrame({
                "_key": batch["_key"].values, "reply": pd.Series(replies, dtype=object).values,
                "attempts": (batch["_before"] + tries).astype("int32").values})

    keyed = df.withColumn("_key", F.sha2(prompt_col, 256))
    prompts = keyed.select("_key", F.col(prompt_col).alias("_prompt")).dropDuplicates(["_key"])
    if kept is None:
        replies = cut_lineage(prompts.withColumn("_before", F.lit(0)).mapInPandas(run, REPLIES))
    else:
        spark = df.sparkSession
        before = cut_lineage(kept_replies(spark, kept))
        settled = before.where(F.col("reply").isNotNull() | (F.col("attempts") >= most_attempts))
        failed = before.join(settled.select("_key"), "_key", "left_anti").select("_key", F.col("attempts").alias("_before"))
        asked = prompts.join(settled.select("_key"), "_key", "left_anti").join(failed, "_key", "left").fillna(0, ["_before"])
        asked.mapInPandas(run, REPLIES).write.mode("append").parquet(kept)
        replies = kept_replies(spark, kept)
    return with_replies(keyed, replies, reply_col)


def with_replies(keyed: DataFrame, replies: DataFrame, reply_col: str) -> DataFrame:
    """keyed (with _key, the digest of its prompt) with the reply of each prompt, or null."""
    return lookup_join(keyed, replies.select("_key", F.col("reply").alias(reply_col)), "_key").drop("_key")


def asked_prompts(df: DataFrame, content: str, task: str = DEFAULT_PROMPT) -> DataFrame:
    return df.withColumn(
        "_prompt", prompt(F.col(content), F.col("sender_domain"), F.col("footer_text"), F.col("urls"), task))


def merged_result(replied: DataFrame, content: str, table: Keywords = rules.CATEGORY_KEYWORDS) -> DataFrame:
    """Add struct ``result``: the valid reply in _reply, or else the fallback."""
    fallback = fallback_result(F.col(content), F.col("sender_domain"), F.col("urls"), table)
    return replied.withColumn("result", F.coalesce(parse_reply(F.col("_reply")), fallback)).drop("_prompt", "_reply")


def classify_from_replies(
    df: DataFrame, replies: DataFrame, content: str, table: Keywords = rules.CATEGORY_KEYWORDS, task: str = DEFAULT_PROMPT,
) -> DataFrame:
    """``classify_with_model`` from a table of replies (_key, reply) alone; nothing is asked."""
    keyed = asked_prompts(df, content, task).withColumn("_key", F.sha2("_prompt", 256))
    return merged_result(with_replies(keyed, replies, "_reply"), content, table)


def classify_with_model(
    df: DataFrame, model: Callable[[pd.Series], pd.Series], content: str,
    table: Keywords = rules.CATEGORY_KEYWORDS, task: str = DEFAULT_PROMPT, kept: str | None = None,
) -> DataFrame:
    """Add struct ``result``: the model's valid reply, or else the fallback. ``kept`` as in ``call_model``."""
    replied = call_model(asked_prompts(df, content, task), "_prompt", "_reply", model, kept)
    return merged_result(replied, content, table)
