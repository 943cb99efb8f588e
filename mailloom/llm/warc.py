"""A content-addressed WARC archive.

An archive is two Parquet folders: `headers` has one row per record with the exact bytes of its header, `payloads`
has each payload once, under its SHA-256. A record is its header followed, for a response, by the payload of the
digest that the header names; reading joins the two again. Of records with equal payloads of at least min_revisit
bytes, that with the smallest identifier is the response and the others are revisits of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm.common import look_up, stored, text_of

MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column, digest: Column, pos: Column) -> Column:
    """A URN that depends on identifier, payload and place in the table only."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.concat(F.lit("row"), pos.cast("string"))), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "1970-01-01T00:00:00Z",
                  min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of pages under path.

    A null payload is an empty one; a null URL gives an empty field, and line ends in one are percent-encoded. A null
    identifier comes after all others; of rows that tie in identifier and payload, one is the response. Repeated rows
    give a record each. Each payload crosses the network once at most per partition that holds it.
    """
    payload = text_of(pages[payload_col])
    slim = stored(pages.select(
        pages[id_col].alias("page_id"), text_of(pages[url_col]).alias("url"), F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"), F.xxhash64(payload).alias("second"),
        F.spark_partition_id().alias("slot"), F.monotonically_increasing_id().alias("pos"),
    ), "records")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "pos")).alias("first")
    same = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("second") == F.max("second"))
    groups = slim.groupBy("digest").agg(first, same.alias("same")).select(
        "digest", F.col("first.page_id").alias("first_id"), F.col("first.pos").alias("first_pos"),
        F.assert_true("same", F.lit("equal digests of different payloads")).alias("checked"))
    rows = look_up(slim, groups, ["digest"]).filter("checked is null")
    is_revisit = (F.col("n_bytes") >= min_revisit) & (F.col("pos") != F.col("first_pos"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"), F.col("pos"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(is_revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", record_id(F.col("first_id"), F.col("digest"), F.col("first_pos"))),
        )).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, "0").otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    rows.select(
        "page_id", "slot", F.when(is_revisit, F.col("first_id")).alias("refers_to"),
        header.cast("binary").alias("header"),
    ).write.parquet(f"{path}/headers")
    (pages.select(F.unhex(F.sha2(payload, 256)).alias("digest"), payload.cast("binary").alias("payload"))
     .dropDuplicates(["digest"]).write.parquet(f"{path}/payloads"))


def field(name: str) -> Column:
    """A field of a record's header, null where it isn't there."""
    value = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, header, type, refers_to, digest, n_bytes, payload, record.

    Everything but the table's keys comes from the stored bytes. Each payload is digested again, whole; one that
    doesn't match the digest it is stored under, or a header without its payload, stops the job.
    """
    heads = spark.read.parquet(f"{path}/headers").withColumns({
        "type": field("WARC-Type"),
        "digest": F.unhex(F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "")),
        "length": field("Content-Length").cast("long"),
    })
    payloads = spark.read.parquet(f"{path}/payloads").select(
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.lit("a payload doesn't match its digest"))).alias("digest"),
        F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
    found = look_up(heads, payloads, ["digest"])
    wrong = F.col("n_bytes").isNull() | ((F.col("type") == "response") & (F.col("n_bytes") != F.col("length")))
    block = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return found.select(
        "page_id", "header", "type", "refers_to", "digest",
        F.when(wrong, F.raise_error(F.lit("a record's payload is missing or has another length")).cast("long"))
        .otherwise(F.col("n_bytes")).alias("n_bytes"),
        "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
