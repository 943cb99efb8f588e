"""Personal data: base spans against brute force, candidates, and trees."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from mailloom.llm import boosting, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    twice = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(number))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def brute(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(number) <= 19 and luhn(number)
                    or kind == "phone" and 9 <= len(number) <= 15):
                yield f"{kind}:{m.start()}:{m.end()}"


def check(frame):
    found = {(str(r.doc_id), r.base_sha256): r for r in pii.report(frame).collect()}
    for r in frame.collect():
        spans = list(brute(r.text))
        got = found[str(r.doc_id), hashlib.sha256(",".join(spans).encode()).hexdigest()]
        assert [got[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert set(spans) <= set(got.spans.split(",")) or not spans
    return found


def test_base_rules(spark):
    texts = [
        "a@b.c+d@e.f x@y.z.w..q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3", "😀 a@b.cc 😀 +1 212 555 0143",
        "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 4111  1111", "mail a@b.c.@d.e.f@g.h",
        "+1 (212) 555-0143-- +12345678 +1234567890123456 ++49 30 555 12 34 5", "1" * 30 + ".2.3.4", "", None,
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_long_runs_take_linear_time_and_no_deep_stack(spark):
    texts = ["x" * 300_000 + "@", "a@" + "b." * 100_000 + "c", "9 " * 100_000 + "1", "+" + "1 " * 100_000, "1" * 100_000,
             "a@b.cc " * 20_000]
    found = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].n_email for i in range(6)] == [0, 1, 0, 0, 0, 20_000]


def test_awkward_and_nothing(awkward, nothing):
    check(awkward)
    assert pii.report(awkward).count() == awkward.count()
    assert pii.report(nothing).count() == 0


def test_candidates(spark):
    texts = ["my phone is (212) 555-0143 .", "write to jane (at) mail.example.com please", "order 2024-10-12 10 came",
             "we look at example.com today", "card: 4111.1111.1111.1111 .", "from host 2001:db8::1 .",
             "+1 (212) 555-0143 is one number, not two"]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[0] == "phone:12:26" and found[1] == "email:9:35"
    assert found[2] == found[3] == "" and found[4] == "card:6:25" and found[5] == "ip:10:21"
    assert found[6] == "phone:0:17"


def test_candidates_next_to_others(spark):
    texts = {
        "call 212 555 0143 415 555 0188 now": ["212 555 0143", "415 555 0188"],
        "😀 call 212 555 0143 2024 1000": ["212 555 0143"],
        "phone 415-555-0199 24 hours": ["415-555-0199"],
        "tel 212-555-0143,415-555-0188": ["212-555-0143", "415-555-0188"],
        "card 4111.1111.1111.1111 2025 1000": ["4111.1111.1111.1111"],
        "write to jane (AT) mail.example.com or ann AT corp DOT example DOT net please": [
            "jane (AT) mail.example.com", "ann AT corp DOT example DOT net"],
        "phones 212-555-0143 415-555-0188 303-555-0122 617-555-0107": [
            "212-555-0143", "415-555-0188", "303-555-0122", "617-555-0107"],
        "order 100 200 300 400 500 600 700": [],
    }
    rows = pii.report(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        text = list(texts)[r.doc_id]
        found = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        assert [text[a:b] for a, b in sorted(found)] == texts[text]


def test_no_notation_is_cut_or_missed(spark):
    long = "y" * 80 + " (at) example.org"
    texts = {
        "call me on 0301234567 please": ["0301234567"], "tel 2125550143": ["2125550143"], "phone 212 5550143 now": ["212 5550143"],
        "mobile 07911 123456": ["07911 123456"], "call (212)555-0143 today": ["(212)555-0143"], "ping ::1 again": ["::1"],
        "write to jane (at) a.b.c.d.e.f.com": ["jane (at) a.b.c.d.e.f.com"], f"mail {long} .": [long],
        "call 303.555.0166 303.555.0177 now": ["303.555.0166", "303.555.0177"],
        "order 1234567890 came": [], "serial 0301234567": [], "std::bad and ns::add": [],
        "address: 2001:db8:85a3:: .": ["2001:db8:85a3::"],
    }
    rows = pii.report(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        text = list(texts)[r.doc_id]
        found = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s]
        assert (text, [text[a:b] for a, b in sorted(found)]) == (text, texts[text])


def test_only_what_overlaps_the_likeliest_goes(spark):
    rows = [(1, "phone", False, 0, 10, 0.7), (1, "phone", False, 8, 20, 0.9), (1, "phone", False, 18, 30, 0.8), (1, "phone", False, 28, 40, 0.6),
            (2, "phone", False, 0, 10, 0.9), (2, "phone", False, 8, 20, 0.7), (2, "card", False, 18, 30, 0.8), (2, "ip", False, 40, 41, 0.7)]
    kept = pii.resolve(spark.createDataFrame(rows, "row long, kind string, base boolean, start int, end int, p double"))
    assert sorted((r.row, r.start) for r in kept.collect()) == [(1, 8), (1, 28), (2, 0), (2, 18), (2, 40)]


def test_overlaps(spark):
    rows = [(1, "phone", True, 5, 9, 1.0), (1, "card", False, 8, 20, 0.9), (1, "card", True, 7, 12, 1.0),
            (1, "phone", False, 20, 30, 0.8), (1, "card", False, 25, 40, 0.9), (1, "ip", False, 40, 41, 0.7)]
    kept = pii.resolve(spark.createDataFrame(rows, "row long, kind string, base boolean, start int, end int, p double"))
    assert sorted((r.start, r.end) for r in kept.collect()) == [(5, 9), (7, 12), (25, 40), (40, 41)]


def test_redaction(spark):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("kind"))
                      for a, b, k in ((2, 4, "ip"), (4, 5, "card"))))
    row = spark.range(1).select(pii.redact(F.lit("abcdefg"), spans).alias("x")).first()
    assert row.x == "ab[IP][CARD]fg"


def test_trees_learn_an_interaction_and_agree_as_columns(spark):
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (300, 3)).astype(float)
    labels = (rows[:, 0] != rows[:, 1]).astype(float)
    trees = boosting.boost(rows + rng.normal(0, 0.01, rows.shape), labels)
    margin = boosting.margins(trees, rows)
    assert ((margin > 0) == (labels > 0)).all()
    frame = spark.createDataFrame([tuple(map(float, r)) for r in rows[:20]], "a double, b double, c double")
    found = [r.m for r in frame.select(boosting.column(trees, [F.col(c) for c in "abc"]).alias("m")).collect()]
    assert np.allclose(found, margin[:20])
    a, b = boosting.platt(margin, labels)
    assert a > 0 and abs(b) < 1
