"""Row types shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ENTITY = T.StructType(_strings("name", "website", "dpo_email", "industry", "location"))

EXTRACTED = T.StructType([
    T.StructField(n, T.ArrayType(T.StringType()))
    for n in ("email", "phone_number", "credit_card_number")
])

METADATA = T.StructType([
    *_strings("sender_domain", "footer_text"),
    T.StructField("urls", T.ArrayType(T.StringType())),
])

MODEL_REPLY = T.StructType([
    T.StructField("email_category", T.StringType()),
    T.StructField("business_entity", ENTITY),
    T.StructField("data", EXTRACTED),
    T.StructField("confidence_score", T.DoubleType()),
])

SPAN = T.StructType([
    *_strings("entity_type", "rule"),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

INDEX_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    *_strings(
        "document", "sender_domain", "email_category", "business_name", "business_website",
        "business_industry", "business_location", "dpo_email",
    ),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("urls_count", T.IntegerType()),
    T.StructField("has_footer", T.BooleanType()),
])

# Amounts of a stored result are decimals at rest and doubles in computation.
STORED_SCORE = T.DecimalType(18, 6)
