"""Whole texts, markup that is not there, failing models, and other faults that were found once."""

import hashlib
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from mailloom.config import DEFAULT_CONFIG
from mailloom.functions import footers, links, text
from mailloom.operators import classify, ingest, pii, privacy
from mailloom.sources.index import VectorIndex


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


def test_nothing_is_cut_unless_asked_for():
    assert DEFAULT_CONFIG.max_email_length is None and DEFAULT_CONFIG.max_policy_length is None


def test_all_named_references(spark):
    assert one(spark, "a&commat;b&period;c &lpar;x&rpar; &hellip; &amp &notit; &nosuch;", text.decode_entities) == (
        "a@b.c (x) \u2026 & \u00acit; &nosuch;")


def test_comments_and_scripts_hold_no_links_or_footers(spark):
    page = ('<!-- <a href="https://no.example/1">x</a><footer>wrong</footer> --><script>"<a href=https://no.example/2>"'
            '</script><a href="https://yes.example">Privacy</a><footer>right</footer><!-- <footer>late</footer> -->')
    assert one(spark, page, links.html_urls) == ["https://yes.example"]
    assert [a["href"] for a in one(spark, page, links.anchors)] == ["https://yes.example"]
    assert one(spark, page, footers.footer_from_html) == "right"


def test_a_bad_prompt_costs_one_reply_and_equal_prompts_are_asked_once(spark, tmp_path):
    log = f"{tmp_path}/asked"

    def model(prompts: pd.Series) -> list:
        with open(log, "a") as out:
            out.writelines(f"{p}\n" for p in prompts if p != "bad" and len(prompts) > 1)
        if (prompts == "bad").any():
            raise ValueError("bad")
        return [p.upper() for p in prompts]

    rows = [(i, "hot" if i % 2 else f"p{i}") for i in range(40)] + [(100, "bad")]
    df = spark.createDataFrame(rows, "i int, p string").repartition(3)
    got = {r["i"]: r["r"] for r in classify.call_model(df, "p", "r", model).collect()}
    assert got == {i: None if p == "bad" else p.upper() for i, p in rows}
    asked = open(log).read().split()
    assert len(asked) == len(set(asked))


def test_nested_spans_of_any_score(spark):
    rows = [(1, "PERSON", "model", 0, 20, 0.6, "x"), (1, "PERSON", "model", 5, 9, 0.6, "y"), (1, "SSN", "r", 5, 9, 0.99, "z")]
    spans = spark.createDataFrame(rows, "k int, entity_type string, rule string, start int, end int, score double, text string")
    assert sorted(r["text"] for r in pii.resolve_overlaps(spans, "k").collect()) == ["x", "z"]


def test_long_runs_without_an_address_are_fast(spark):
    start = time.time()
    assert one(spark, "x" * 200_000 + " dpo@a.example data protection", privacy.dpo_email) == "dpo@a.example"
    assert time.time() - start < 20


def test_senders_must_be_addresses(spark):
    good = '{"from":"a@b.example","subject":"s","html_content":null}'
    nobody = '{"from":"nobody","subject":"s","html_content":null}'
    assert one(spark, good, ingest.problem) is None
    assert one(spark, nobody, ingest.problem) == "invalid sender"
    assert one(spark, '{"from":1,"subject":null,"html_content":null}', ingest.problem) == "invalid sender"


def test_overlapping_hits_leave_nothing_behind(spark):
    leak = "mail john.4111111111111111@x.com now"
    assert one(spark, leak, pii.mask) == "mail " + "*" * 27 + " now"
    assert one(spark, leak, pii.replace) == "mail [REDACTED] now"
    digest = hashlib.sha256(b"john.4111111111111111@x.com").hexdigest()
    assert one(spark, leak, pii.hash_spans) == f"mail {digest} now"
    assert one(spark, "a@b.com 4111111111111111 \U0001f600 555-123-4567", pii.mask) == (
        "*" * 7 + " " + "*" * 16 + " \U0001f600 " + "*" * 12)


def test_an_unreadable_index_is_an_error_and_a_missing_one_is_empty(spark, tmp_path):
    assert VectorIndex(spark, f"{tmp_path}/none").read().count() == 0
    (tmp_path / "bad" / "manifest").mkdir(parents=True)
    (tmp_path / "bad" / "manifest" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception) as caught:
        VectorIndex(spark, f"{tmp_path}/bad").read().count()
    assert not isinstance(caught.value, AnalysisException) or caught.value.getCondition() != "PATH_NOT_FOUND"
