from pyspark.sql import functions as F

from mailloom.operators.embed import embed, hashing_embed
from mailloom.plans import jobs
from mailloom.plans.messages import Hooks, describe, process_messages
from mailloom.sources.index import VectorIndex

PAGES = [
    (1, "https://a.com/x", '<a href="/p">p</a><a href="https://b.org/q">q</a><a href="/p">p</a>'),
    (2, "https://www.a.com/", '<a href="z">z</a>'),
]


def messages(spark):
    rows = [
        (1, "n@a.com", "s", '<p>Mail x@y.de</p><a href="https://a.com/1">1</a>', None),
        (2, "m@b.com", "s", None, "line one\nline two\ncontact us at c@d.io"),
        (3, "broken", "s", "", None),
    ]
    return spark.createDataFrame(rows, "email_id int, from_email string, subject string, html_content string, text_content string")


def test_clean_corpus(spark):
    got = {r["email_id"]: r["clean_text"] for r in jobs.clean_corpus(messages(spark)).collect()}
    assert got == {1: "Mail x@y.de1", 2: "line one\nline two\ncontact us at c@d.io", 3: ""}


def test_link_table(spark):
    pages = spark.createDataFrame(PAGES, "id int, url string, html string")
    out = jobs.link_table(pages, "id", "html", "url")
    assert sorted(r["url"] for r in out["links"].collect()) == ["https://a.com/p", "https://b.org/q", "https://www.a.com/z"]
    assert {tuple(r) for r in out["roots"].collect()} == {("a.com", 2), ("b.org", 1)}


def test_metadata_table(spark):
    got = {r["email_id"]: r for r in jobs.metadata_table(messages(spark)).collect()}
    assert got[1]["urls"] == ["https://a.com/1"] and got[1]["footer_text"] is None
    assert got[2]["footer_text"] == "line one\nline two\ncontact us at c@d.io"
    assert got[3]["sender_domain"] == "unknown"


def test_pii_jobs(spark):
    df = messages(spark).select("email_id", F.coalesce("html_content", "text_content").alias("body"))
    out = jobs.pii_scan(df, "email_id", "body")
    assert sorted(r["text"] for r in out["spans"].collect()) == ["c@d.io", "x@y.de"]
    assert [tuple(r) for r in out["totals"].collect()] == [("EMAIL_ADDRESS", 2)]
    assert {(r["email_id"], r["value"]) for r in out["values"].collect()} == {(1, "x@y.de"), (2, "c@d.io")}
    assert sorted(r["spans"] for r in out["per_message"].collect()) == [1, 1]
    for way, text in (("mask", "******"), ("replace", "[REDACTED]"), ("default", "******")):
        assert text in jobs.pii_redact(df, "body", way).where("email_id = 2").first()["body"]


def test_result_reports(spark):
    r = spark.createDataFrame([("survey", "a.com", 0.9, 1.0)], "email_category string, sender_domain string, confidence_score double, processing_time double")
    out = jobs.result_reports(r)
    assert out["latency"].first()["passed"] is True and out["high_confidence"].first()["high_confidence"] == 1
    assert out["categories"].first()["percent"] == 100.0 and out["statistics"].count() == 4


def test_embedding_model_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "id int, t string")
    got = {r["id"]: list(r["embedding"]) for r in embed(df, "t", lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    same = hashing_embed(spark.createDataFrame([(1, "A b"), (2, "b, a")], "id int, t string"), "t").collect()
    assert same[0]["embedding"] == same[1]["embedding"]


def test_masked_source_and_failing_classifier(spark):
    masked = {r["email_id"]: r["data"]["email"] for r in describe(messages(spark), data_source="masked").collect()}
    assert masked == {1: [], 2: [], 3: []}

    def broken(prompts):
        raise ValueError("model is away")

    rows = process_messages(messages(spark), VectorIndex(spark, "/nowhere/index").read(), hooks=Hooks(classify=broken)).collect()
    assert {r["confidence_score"] for r in rows} == {0.3} and len(rows) == 3
