import json

import pytest
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.operators import ingest
from mailloom.operators.embed import hashing_embed
from mailloom.plans import jobs
from mailloom.plans.messages import Hooks, PageTable, index_entries, process_messages
from mailloom.sources import messages as source
from mailloom.sources import results as sink
from mailloom.sources.index import VectorIndex
from mailloom.streaming.messages import ingest_stream, process_stream

MAILS = {
    "email_01_marketing_shop_com.json": {
        "from": "news@shop.com", "subject": "Sale!",
        "html_content": "<html><h1>Big sale</h1><p>Ask customer@example.com or +1-555-123-4567</p>"
                        "<a href=\"https://shop.com/sale\">Buy</a><footer>Shop Inc.</footer></html>"},
    "email_02_transactional_bank_org.json": {
        "from_email": "info@bank.org", "subject": "Receipt", "html_content": "<p>Your payment receipt. Card 4111111111111111.</p>"},
    "email_03_family_net.json": {"from": "joe@family.net", "subject": "Hi", "html_content": "<p>See you soon</p>"},
    "email_04_broken.json": "{not json",
    "email_05_nobody.json": {"from": "x@y.z", "subject": "no body"},
    "email_06_null.JSON": {"from": "n@null.com", "subject": "null body", "html_content": None},
    "report.json": {"from": "not@a.mail", "subject": "", "html_content": ""},
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i, (name, body) in enumerate(MAILS.items()):
        place = tmp_path / "in" / ("deep" if i % 2 else "") / name
        place.write_text(body if isinstance(body, str) else json.dumps(body, indent=2), encoding="utf-8")
    return tmp_path


def test_validation_reasons(spark):
    rows = ["{bad", "{}", '{"from":"a@b.co","subject":null,"html_content":null}', '{"from_email":"a@b.co","subject":"s","html_content":"h"}', "", '[1]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = [r["error"] for r in ingest.with_problem(df).orderBy("i").collect()]
    assert got == ["invalid JSON", "missing required fields: from, subject, html_content", None, None, "invalid JSON", "invalid JSON"]
    assert tuple(ingest.ingest_report(ingest.with_problem(df)).first()) == (6, 2, 4, 33.3)
    assert tuple(ingest.ingest_report(ingest.with_problem(df.limit(0))).first()) == (0, 0, 0, 0.0)


def test_folder(spark, folder):
    out = jobs.ingest_folder(spark, str(folder / "in"))
    assert tuple(out["report"].first()) == (6, 4, 2, 66.7)
    labels = {r["from_email"]: (r["expected_category"], r["expected_domain"]) for r in out["messages"].collect()}
    assert labels["news@shop.com"] == ("marketing", "shop.com")
    assert labels["joe@family.net"] == (None, "family.net")
    assert labels["info@bank.org"] == ("transactional", "bank.org")
    assert out["quarantine"].count() == 2 and out["status"].where("status = 'queued'").count() == 4


def test_process_messages_routes_and_enriches(spark, folder):
    messages, _ = source.read_emails(spark, str(folder / "in"))
    empty = VectorIndex(spark, str(folder / "none")).read()
    first = process_messages(messages, empty)
    rows = {r["metadata"]["sender_domain"]: r for r in first.collect()}
    shop = rows["shop.com"]
    assert (shop["route"], shop["email_category"], shop["confidence_score"]) == ("classifier", "marketing", 0.3)
    assert shop["business_entity"]["name"] == "Shop" and shop["business_entity"]["website"] == "https://shop.com/sale"
    assert shop["data"]["email"] == ["customer@example.com"] and shop["metadata"]["footer_text"] == "Shop Inc."
    assert "customer@example.com" not in shop["document"]
    assert rows["bank.org"]["data"]["credit_card_number"] == ["4111111111111111"]

    entries = index_entries(first.withColumn("confidence_score", F.lit(0.9)))
    pages = spark.createDataFrame(
        [(1, "https://shop.com/privacy", "Our data protection officer is dpo@shop.com. " + "word " * 40)], "page_id int, url string, html string")
    again = process_messages(messages, entries, pages=PageTable(pages))
    rows = {r["metadata"]["sender_domain"]: r for r in again.collect()}
    assert {r["route"] for r in rows.values()} == {"match"}
    assert rows["shop.com"]["business_entity"]["dpo_email"] == "dpo@shop.com"
    assert rows["bank.org"]["business_entity"]["dpo_email"] is None
    assert rows["shop.com"]["confidence_score"] == pytest.approx(1.0)
    assert index_entries(again).count() == 4 and index_entries(again, dedup_distance=0.01).count() == 0


def test_model_hook_sees_only_the_rest(spark, folder):
    messages, _ = source.read_emails(spark, str(folder / "in"))
    empty = VectorIndex(spark, str(folder / "none")).read()
    known = index_entries(process_messages(messages.where("from_email = 'news@shop.com'"), empty).withColumn("confidence_score", F.lit(0.9)))
    reply = '{"email_category":"survey","business_entity":{"name":"M"},"data":{},"confidence_score":0.7}'

    def model(prompts):
        assert not any("Big sale" in p for p in prompts)
        return [reply] * len(prompts)

    rows = process_messages(messages, known, hooks=Hooks(classify=model)).collect()
    assert sorted((r["route"], r["business_entity"]["name"]) for r in rows) == [("classifier", "M")] * 3 + [("match", "Shop")]
    assert {tuple(r["data"]["credit_card_number"]) for r in rows} == {(), ("4111111111111111",)}


def test_parser_mode_agrees(spark, folder):
    messages, _ = source.read_emails(spark, str(folder / "in"))
    a = sorted(tuple(map(str, r)) for r in jobs.metadata_table(messages).collect())
    b = sorted(tuple(map(str, r)) for r in jobs.metadata_table(messages, mode="parser").collect())
    assert a == b


def test_stream_equals_batch_and_replays_do_not_double(spark, folder):
    work = str(folder / "work")
    query = ingest_stream(spark, str(folder / "in"), work, files_per_trigger=3)
    query.awaitTermination(120)
    assert query.exception() is None
    stored = sink.read_results(spark, f"{work}/results")
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    assert dict(stored.dtypes)["confidence_score"] == "decimal(18,6)"
    assert stored.select("batch").distinct().count() == 2
    assert spark.read.parquet(f"{work}/quarantine").count() == 2
    messages, _ = source.read_emails(spark, str(folder / "in"))
    batch = process_messages(messages, VectorIndex(spark, f"{work}/index").read())
    key = lambda df, *c: sorted(tuple(map(str, r)) for r in df.select(*c).collect())
    assert key(stored, "sender_domain", "email_category") == key(batch, "metadata.sender_domain", "email_category")


def test_later_batches_see_confident_results_of_earlier_ones(spark, folder):
    work = str(folder / "work")
    target = folder / "queue"
    target.mkdir()
    mail = json.dumps(MAILS["email_01_marketing_shop_com.json"])
    config = EngineConfig(confidence_threshold=0.25)
    for n in (1, 2, 3):
        (target / f"email_{n}.json").write_text(mail)
        query = ingest_stream(spark, str(target), work, config=config)
        query.awaitTermination(120)
        assert query.exception() is None
    got = sink.read_results(spark, f"{work}/results").orderBy("batch").collect()
    assert [float(r["confidence_score"]) for r in got] == [0.3, 1.0, 1.0]
    index = VectorIndex(spark, f"{work}/index")
    assert index.read().count() == 3 and index.read(before_batch=1).count() == 1


def test_index_delete_compact_reset(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.read().count() == 0
    docs = hashing_embed(spark.createDataFrame([(str(i), f"text {i}") for i in range(4)], "id string, document string"), "document")
    blank = {c: F.lit(None).cast("string") for c in (
        "sender_domain", "email_category", "business_name", "business_website", "business_industry", "business_location", "dpo_email")}
    rows = docs.withColumns(blank).withColumns(
        {"confidence_score": F.lit(0.9), "urls_count": F.lit(0), "has_footer": F.lit(False)})
    index.append(rows.where("id < 2"), 0)
    index.append(rows.where("id >= 2"), 1)
    index.append(rows.where("id >= 2"), 1)
    assert index.read().count() == 4
    index.delete(spark.createDataFrame([("1",)], "id string"))
    assert sorted(r["id"] for r in index.read().collect()) == ["0", "2", "3"]
    index.append(rows.where("id = 1"), 2)
    index.compact()
    assert index.read().count() == 4
    index.append(rows.where("id >= 2"), 1)  # a replay replaces its batch also after compacting
    assert sorted(r["id"] for r in index.read().collect()) == ["0", "1", "2", "3"]
    assert sorted(r["id"] for r in index.read(before_batch=1).collect()) == ["0"]
    index.reset()
    assert index.read().count() == 0


def test_results_append(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "a.com"), ("k2", "b.com")], "email_id string, sender_domain string")
    path = str(tmp_path / "results")
    stored = sink.stored_form(rows, "email_id", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    sink.append_results(stored, path)
    back = sink.read_results(spark, path)
    assert back.count() == 2 and {str(r["dt"]) for r in back.collect()} == {"2024-01-02"}
    assert sink.stored_form(rows).select("id").distinct().count() == 2


def test_stream_of_whole_messages(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    rows = [json.dumps(MAILS["email_03_family_net.json"]), "{bad", json.dumps(MAILS["email_02_transactional_bank_org.json"])]
    (tmp_path / "lines" / "a.txt").write_text("\n".join(rows))
    lines = spark.readStream.text(str(tmp_path / "lines"))
    named = lines.select(F.sha2("value", 256).alias("source_file"), F.col("value").alias("raw"))
    query = process_stream(named, str(tmp_path / "work"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = sink.read_results(spark, str(tmp_path / "work" / "results"))
    assert sorted(r["sender_domain"] for r in got.collect()) == ["bank.org", "family.net"]
    assert spark.read.parquet(str(tmp_path / "work" / "quarantine")).count() == 1
