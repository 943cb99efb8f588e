import hashlib
import re

from pyspark.sql import functions as F

from mailloom.operators import pii

TEXTS = [
    "mail a.b@c.io and a.b@c.io", "4111111111111111", "é4111111111111111 x", "+1 (743) 555-3824 end", "no data",
    "call 555-123-4567, +442071838750", "ssn 123-45-6789", "a@b.co4111111111111111", "", None,
    "ünï x@y.de ß 378282246310005 5555555555554444",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_spans_read_back_as_their_text(spark):
    spans = pii.pii_spans(frame(spark).withColumn("whole", F.col("text")), "text").collect()
    assert len(spans) > 8
    for s in spans:
        assert s["whole"][s["start"]:s["end"]] == s["text"]


def test_spans_equal_python_matches(spark):
    got = {(s["id"], s["rule"], s["start"], s["text"]) for s in pii.pii_spans(frame(spark), "text").collect()}
    want = {
        (i, r.name, m.start(), m.group(0))
        for i, t in enumerate(TEXTS) if t for r in pii.PII_RULES for m in re.finditer(r.pattern, t)
    }
    assert got == want


def test_mask_keeps_length_and_is_final(spark):
    once = frame(spark).select("id", "text", pii.mask(F.col("text")).alias("m"))
    for r in once.select("text", "m", pii.mask(F.col("m")).alias("again")).collect():
        if r["text"] is not None:
            assert len(r["m"]) == len(r["text"])
            assert r["again"] == r["m"]
    rows = {r["id"]: r["m"] for r in once.collect()}
    assert rows[0] == "mail ******** and ********"
    assert rows[3] == "+**************** end".replace("+****************", "+" + "*" * len("1 (743) 555-3824"))
    assert rows[4] == "no data" and rows[8] == "" and rows[9] is None


def test_mask_plus(spark):
    row = frame(spark).where("id = 3").select(pii.mask(F.col("text"), mask_plus=True)).first()
    assert row[0] == "*" * len("+1 (743) 555-3824") + " end"


def test_replace_and_hash(spark):
    row = frame(spark).where("id = 0").select(
        pii.replace(F.col("text")).alias("r"), pii.hash_spans(F.col("text")).alias("h")).first()
    digest = hashlib.sha256(b"a.b@c.io").hexdigest()
    assert row["r"] == "mail [REDACTED] and [REDACTED]"
    assert row["h"] == f"mail {digest} and {digest}"


def test_rewrite_by_entity(spark):
    choices = (("EMAIL_ADDRESS", "replace"), ("CREDIT_CARD", "mask"))
    df = spark.createDataFrame([("x@y.de 378282246310005 123-45-6789",)], "text string")
    assert df.select(pii.rewrite_by_entity(F.col("text"), choices)).first()[0] == "[REDACTED] *************** 123-45-6789"


def test_extract_is_distinct_and_sorted(spark):
    row = frame(spark).select("id", pii.extract(F.col("text")).alias("d")).where("id in (0, 10)").orderBy("id").collect()
    assert row[0]["d"]["email"] == ["a.b@c.io"] and row[0]["d"]["phone_number"] == []
    assert row[1]["d"]["credit_card_number"] == ["378282246310005", "5555555555554444"]


def test_thresholds(spark):
    spans = spark.createDataFrame(
        [("EMAIL_ADDRESS", 0.5), ("EMAIL_ADDRESS", 0.49), ("CREDIT_CARD", 0.7), ("OTHER", 0.35), ("OTHER", 0.3)],
        "entity_type string, score double")
    assert sorted(tuple(r) for r in pii.apply_thresholds(spans).collect()) == [("EMAIL_ADDRESS", 0.5), ("OTHER", 0.35)]


def _covered(s, t):
    inside = t[1] <= s[1] and t[2] >= s[2] and t[3] >= s[3] and t != s
    strictly = t[1] < s[1] or t[2] > s[2] or t[3] > s[3] or t[4] < s[4]
    return inside and strictly


def test_overlaps_against_brute_force(spark):
    import random
    rnd = random.Random(3)
    levels = (0.7, 0.8, 0.9)
    rows = set()
    for key in range(20):
        for i in range(30):
            a = rnd.randrange(60)
            rows.add((key, a, a + rnd.randrange(1, 20), rnd.choice(levels), f"r{i}"))
    df = spark.createDataFrame(sorted(rows), "id int, start int, end int, score double, rule string")
    want = sorted(s for s in rows if not any(t[0] == s[0] and _covered(s, t) for t in rows))
    for stretch in (pii.STRETCH, 7):
        assert sorted(tuple(r) for r in pii.resolve_overlaps(df, "id", levels, stretch).collect()) == want


def test_luhn_filter(spark):
    df = spark.createDataFrame([("4111111111111111 4111111111111112",)], "text string")
    kept = pii.pii_spans(df, "text", ["CREDIT_CARD"], check_cards=True).collect()
    assert [k["text"] for k in kept] == ["4111111111111111"]


def test_model_spans(spark):
    def model(texts):
        return texts.map(lambda t: [("PER", 0, 4), ("O", 5, 6)] if t.startswith("mail") else [])

    got = pii.model_spans(frame(spark), "id", "text", model, 0.85).collect()
    assert [(g["id"], g["entity_type"], g["text"]) for g in got] == [(0, "PERSON", "mail")]


def test_stats_by_group(spark):
    got = {tuple(r) for r in pii.pii_stats(frame(spark), "text").collect()}
    assert ("SSN", 1) in got and ("EMAIL_ADDRESS", 3) in got or ("EMAIL_ADDRESS", 4) in got


def _union(found):
    """Spans (start, end, score, type) -> united ones (start, end, type)."""
    groups = []
    for span in sorted(found):
        if groups and span[0] < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], span[1])
            groups[-1][2].append(span)
        else:
            groups.append([span[0], span[1], [span]])
    return [(a, b, min(members, key=lambda m: (-m[2], m[3]))[3]) for a, b, members in groups]


def _rewritten(text, found, how):
    out, at = [], 0
    for a, b, kind in _union(found):
        out += [text[at:a], how(text[a:b], kind)]
        at = b
    return "".join(out) + text[at:]


LOOSE = (
    pii.PiiRule("digits", "CREDIT_CARD", "[0-9]{3,}", 0.9, digits=3),
    pii.PiiRule("ab", "PHONE_NUMBER", "[ab0-9]{2,5}", 0.7),
    pii.PiiRule("mail", "EMAIL_ADDRESS", r"[a-zé]+@[a-z]+", 0.9, needs="@"),
)


def _cases():
    import random
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("ab01 @é😀x\ufdd0") for _ in range(rnd.choice((0, 3, 20, 200))))) for i in range(120)]
    rows += [(900, None), (901, "ab 123 " * 300), (902, "a@b" * 200 + "12345" * 50)]
    spans = {}
    for i, t in rows:
        n = len(t or "")
        spans[i] = [(rnd.choice(("PERSON", "LOCATION")), a, min(n, a + rnd.randrange(4)), rnd.choice((0.2, 0.5, 0.95)))
                    for a in (rnd.randrange(n) for _ in range(rnd.choice((0, 0, 1, 4, 40))) if n)]
    return rows, spans


def test_one_span_set_decides_about_rewriting(spark):
    rows, spans = _cases()
    df = spark.createDataFrame([
        (i, t, [(k, "model", a, b, s, None) for k, a, b, s in spans[i]]) for i, t in rows],
        "id int, text string, spans array<struct<entity_type:string,rule:string,start:int,end:int,score:double,text:string>>")
    kinds = ["CREDIT_CARD", "PHONE_NUMBER", "EMAIL_ADDRESS", "PERSON", "LOCATION"]
    limits = (("LOCATION", 0.9),)
    options = dict(table=LOOSE, extra=F.col("spans"), thresholds=limits)
    choices = (("CREDIT_CARD", "hash"), ("PHONE_NUMBER", "mask"), ("EMAIL_ADDRESS", "replace"), ("PERSON", "mask"), ("LOCATION", "replace"))
    got = {r["id"]: r for r in df.select(
        "id", pii.mask(F.col("text"), kinds, **options).alias("m"), pii.replace(F.col("text"), kinds, **options).alias("r"),
        pii.hash_spans(F.col("text"), kinds, **options).alias("h"),
        pii.rewrite_by_entity(F.col("text"), choices, **options).alias("e"),
        pii.mask(F.col("text"), ["PERSON"], **options).alias("p"),
        pii.mask(F.col("text"), kinds, table=LOOSE).alias("rules")).collect()}
    sha = lambda hit, _: hashlib.sha256(hit.encode()).hexdigest()
    star = lambda hit, _: "*" * len(hit)
    red = lambda *_: "[REDACTED]"
    way = dict(hash=sha, mask=star, replace=red)
    for i, t in rows:
        if t is None:
            assert got[i]["m"] is None
            continue
        by_rule = [(m.start(), m.end(), r.score, r.entity_type) for r in LOOSE for m in re.finditer(r.pattern, t)]
        extra = [(a, b, s, k) for k, a, b, s in spans[i] if b > a and s >= dict(limits).get(k, 0.35)]
        both = by_rule + extra
        assert got[i]["m"] == _rewritten(t, both, star) and got[i]["r"] == _rewritten(t, both, red)
        assert got[i]["h"] == _rewritten(t, both, sha)
        assert got[i]["e"] == _rewritten(t, both, lambda hit, kind: way[dict(choices)[kind]](hit, kind))
        assert got[i]["p"] == _rewritten(t, [x for x in extra if x[3] == "PERSON"], star)
        assert got[i]["rules"] == _rewritten(t, by_rule, star)


def test_many_hits_of_one_text(spark):
    import time
    text = "call 555-123-4567 or a.b@c.io now " * 10_000
    df = spark.createDataFrame([(text,)], "text string")
    at = time.time()
    spans = pii.pii_spans(df, "text").collect()
    masked = df.select(pii.mask(F.col("text"))).first()[0]
    assert time.time() - at < 60
    assert len(spans) == 20_000 and all(text[s["start"]:s["end"]] == s["text"] for s in spans)
    assert masked == "call ************ or ******** now " * 10_000


def test_entity_model_spans(spark):
    def model(texts):
        return texts.map(lambda t: [("PER", 0, 4), ("O", 5, 6), ("GPE", 2, 900)] if t.startswith("mail") else [])

    got = frame(spark).select("id", pii.entity_spans(F.col("text"), model).alias("s")).collect()
    assert {r["id"]: [tuple(s) for s in r["s"]] for r in got if r["s"]} == {
        0: [("PERSON", "model", 0, 4, 0.85, "mail"), ("LOCATION", "model", 2, len(TEXTS[0]), 0.85, TEXTS[0][2:])]}
