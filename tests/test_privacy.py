import pytest
from pyspark.sql import functions as F

from mailloom.operators import privacy

FILL = " Plain words that make the page long enough to count as a page with something to say, so that it is kept."


def dpo(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(privacy.dpo_email(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("Our Data  Protection Officer: dpo@x.com", "dpo@x.com"),
    ("write to a@x.com, data protection team", "a@x.com"),
    ("Privacy questions go to p@x.com", "p@x.com"),
    ("p@x.com handles privacy", "p@x.com"),
    ("privacy first@x.com ... our DPO is second@x.com", "second@x.com"),
    ("DPO" + "x " * 50 + "a@x.com", "a@x.com"),
    ("DPO" + "- " * 51 + "a@x.com", None),
    ("DPO a@x", None), ("no address", None), (None, None),
])
def test_dpo_email(spark, text, want):
    assert dpo(spark, text) == want


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, u, f"<html><p>{h}</p>{FILL}</html>") for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")


def sites(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "site string")


def resolve(spark, names, rows, **options):
    done = privacy.site_policies(sites(spark, *names), "site", pages(spark, rows), "page_id", "url", "html", **options)
    return {r["site"]: (r["dpo_email"], r["privacy_policy_url"], r["success"], r["error_message"]) for r in done.collect()}


def test_first_candidate_with_an_address_wins(spark):
    got = resolve(spark, ["a.com", "http://b.com/start", "c.com"], [
        ("https://a.com/privacy-policy", "DPO second@a.com"), ("https://a.com/privacy", "nothing here"),
        ("https://a.com/legal/privacy", "DPO third@a.com"), ("http://b.com/privacy/", "DPO x@b.com"),
        ("https://c.com/other", "DPO y@c.com"),
    ])
    assert got["a.com"] == ("second@a.com", "https://a.com/privacy-policy", True, None)
    assert got["http://b.com/start"] == ("x@b.com", "http://b.com/privacy", True, None)
    assert got["c.com"] == (None, None, False, privacy.NOT_FOUND)


def test_links_of_the_first_page_are_followed(spark):
    got = resolve(spark, ["a.com"], [
        ("https://a.com/", '<a href="/x">Data Protection</a><a href="about/privacy2">p</a>'),
        ("https://a.com/x", "DPO late@a.com"), ("https://a.com/about/privacy2", "DPO first@a.com"),
    ])
    assert got["a.com"][:2] == ("first@a.com", "https://a.com/about/privacy2")


def test_no_candidates(spark):
    assert resolve(spark, ["a.com"], [("https://b.com/", "x")], paths=())["a.com"][3] == privacy.NO_URLS


def test_sites_that_share_a_host_or_a_first_page(spark):
    got = resolve(spark, ["a.com/x", "a.com/y", "b.com", "b.com/", "c.com", "d.com/s", "d.com/t"], [
        ("https://a.com/privacy.php", "DPO one@a.com"), ("https://b.com", '<a href="//c.com/privacy-text">privacy</a>'),
        ("https://c.com/", '<a href="/privacy-text">privacy</a>'), ("https://c.com/privacy-text", "DPO two@c.com"),
        ("https://d.com/s", '<a href="/privacy-s">privacy</a>'), ("https://d.com/privacy-s", "DPO three@d.com"),
    ])
    assert got["a.com/x"] == got["a.com/y"] == ("one@a.com", "https://a.com/privacy.php", True, None)
    assert got["b.com"] == got["b.com/"] == got["c.com"] == ("two@c.com", "https://c.com/privacy-text", True, None)
    assert got["d.com/s"] == ("three@d.com", "https://d.com/privacy-s", True, None)
    assert got["d.com/t"] == (None, None, False, privacy.NOT_FOUND)


def test_usual_places_come_before_links_and_copies_are_merged(spark):
    rows = [
        ("https://a.com", '<a href="/z-privacy">p</a>'), ("https://a.com/", '<a href="/y-privacy">p</a>'),
        ("https://a.com/z-privacy", "DPO z@a.com"), ("https://a.com/y-privacy", "DPO y@a.com"),
    ]
    assert resolve(spark, ["a.com"], rows)["a.com"][:2] == ("y@a.com", "https://a.com/y-privacy")
    rows.append(("https://a.com/privacy.html", "DPO usual@a.com"))
    assert resolve(spark, ["a.com"], rows)["a.com"][:2] == ("usual@a.com", "https://a.com/privacy.html")


def test_a_model_reads_only_what_a_wave_asks_for(spark, tmp_path):
    kept = str(tmp_path / "replies")

    def model(prompts):
        return [p.split("write to ")[1].split()[0] if "write to " in p else "None" for p in prompts]

    rows = [
        ("https://a.com/privacy", "write to first@a.com now"), ("https://a.com/privacy-policy", "write to second@a.com now"),
        ("https://b.com/privacy-policy", "nothing, but the DPO by@pattern.com"), ("https://b.com/privacy.php", "write to late@b.com now"),
        ("https://c.com", '<a href="/about-privacy">privacy</a>'), ("https://c.com/about-privacy", "write to link@c.com now"),
        ("https://c.com/elsewhere", "write to nobody@c.com now"),
    ]
    got = resolve(spark, ["a.com", "b.com", "c.com"], rows, model=model, kept=kept)
    assert {s: r[0] for s, r in got.items()} == {"a.com": "first@a.com", "b.com": "by@pattern.com", "c.com": "link@c.com"}
    assert spark.read.parquet(kept).count() == 3  # a's first place, b's second, c's link
    assert resolve(spark, ["a.com", "b.com", "c.com"], rows, model=model, kept=kept) == got
    assert spark.read.parquet(kept).count() == 3


def test_pages_are_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = pages(spark, [("https://a.com/privacy", "DPO a@a.com"), ("https://b.com", '<a href="/privacy2">privacy</a>')])
    counted = rows.mapInArrow(seen, rows.schema)
    done = privacy.site_policies(sites(spark, "a.com", "b.com", "c.com"), "site", counted, "page_id", "url", "html")
    assert done.count() == 3 and reads.value == 2


def test_copies_of_a_page_and_short_pages(spark):
    rows = pages(spark, [("https://a.com/privacy", "nothing"), ("https://a.com/privacy", "DPO a@a.com")])
    short = spark.createDataFrame([(9, "https://b.com/privacy", "DPO b@b.com")], rows.schema)
    got = {r["page_key"]: r["contact"] for r in privacy.page_contacts(rows.union(short), "page_id", "url", "html").collect()}
    assert got == {"https://a.com/privacy": "a@a.com", "https://b.com/privacy": "b@b.com"}
    long = privacy.page_contacts(rows.union(short), "page_id", "url", "html", min_length=100)
    assert {r["page_key"]: r["contact"] for r in long.collect()} == {"https://a.com/privacy": "a@a.com"}


def test_model_comes_first_and_patterns_are_the_fallback(spark):
    rows = pages(spark, [("https://a.com/privacy", "ask me"), ("https://b.com/privacy", "DPO b@b.com")])

    def model(prompts):
        return [" m@a.com " if "ask me" in p else "None" for p in prompts]

    got = {r["page_key"]: r["contact"] for r in privacy.page_contacts(rows, "page_id", "url", "html", model=model).collect()}
    assert got == {"https://a.com/privacy": "m@a.com", "https://b.com/privacy": "b@b.com"}


def test_enrich_fills_only_what_is_missing(spark):
    policies = spark.createDataFrame([("a.com", "dpo@a.com", True), ("b.com", None, False)], "site string, dpo_email string, success boolean")
    rows = spark.createDataFrame(
        [(1, "a.com", None), (2, "a.com", "own@a.com"), (3, "b.com", None), (4, None, None), (5, "a.com", "")],
        "id int, web string, dpo string")
    got = {r["id"]: r["dpo"] for r in privacy.enrich_dpo(rows, policies, "web", "dpo", "site").collect()}
    assert got == {1: "dpo@a.com", 2: "own@a.com", 3: None, 4: None, 5: "dpo@a.com"}
