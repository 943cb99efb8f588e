"""Messages from JSON files, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.operators.ingest import parse_messages, validate

FILES = "email_*.[jJ][sS][oO][nN]"


def raw_messages(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    """(source_file, raw): one row per message file below ``path``, one JSON document each. ``files`` is the pattern of
    their names; where folders bear the messages' names, it can be that of the files in them."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files)
        .text(path, wholetext=True)
    )
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))


def pack_messages(messages: DataFrame, path: str) -> None:
    """Write (source_file, raw) so that many messages share a file, each under its name. Texts of one name are one message, as
    they would be in one file of that name."""
    named = messages.groupBy("source_file").agg(F.collect_list("raw").alias("raw"))
    named.select("source_file", F.array_join("raw", "\n").alias("raw")).write.parquet(path)


def packed_messages(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, raw) of a folder that ``pack_messages`` wrote: no file is listed or opened for a single message."""
    return spark.read.schema("source_file string, raw string").parquet(path)


def raw_message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream: a file that arrives in the folder is one queued message."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", FILES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))


def message_id(df: DataFrame, column: str = "source_file") -> DataFrame:
    """A repeatable id, so that a message read twice is stored once."""
    return df.withColumn("email_id", F.sha2(F.col(column).cast("string"), 256))


def read_emails(
    spark: SparkSession, path: str, required=rules.REQUIRED_KEYS, files: str = FILES, packed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(messages, bad files) of a folder of message files, or of ``packed`` messages."""
    raw = packed_messages(spark, path) if packed else raw_messages(spark, path, files)
    good, bad = validate(raw, required=required)
    return message_id(parse_messages(good)), bad


def label_from_filename(df: DataFrame, column: str = "source_file") -> DataFrame:
    """Add expected_category and expected_domain from names like email_NN_category_domain_tld.json.

    The category is null where the name has none. The name is that of the file, or of a folder that holds it.
    """
    name = F.regexp_extract(column, r"email_\d+_([^/]*)\.[jJ][sS][oO][nN](?:/[^/]*)?$", 1)
    known = "|".join(rules.CATEGORIES)
    category = F.nullif(F.regexp_extract(name, rf"^({known})_", 1), F.lit(""))
    rest = F.regexp_replace(name, rf"^(?:{known})_", "")
    return df.withColumns({
        "expected_category": category,
        "expected_domain": F.nullif(F.replace(rest, F.lit("_"), F.lit(".")), F.lit("")),
    })
