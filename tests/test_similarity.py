import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.operators import classify, lsh, neighbours, routing, similarity
from mailloom.operators.skew import lookup_join


def vectors(seed=1, n=240, dim=8, copies=80, centres=6):
    """Clustered vectors of which a third are copies of one."""
    rnd = np.random.default_rng(seed)
    mid = rnd.normal(size=(centres, dim)) * 3
    x = mid[rnd.integers(centres, size=n)] + rnd.normal(size=(n, dim))
    x[:copies] = x[0]
    return np.float32(x).astype(float)


def frames(spark, x, q=None):
    index = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "c_id long, c_vec array<float>")
    rows = x if q is None else q
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "q_id long, q_vec array<float>")
    return queries, index


def brute(x, q, k, metric, within=None, skip_self=False):
    out = {}
    for i, v in enumerate(q):
        if metric == "sql2":
            d = ((x - v) ** 2).sum(axis=1)
        else:
            d = 1 - (x @ v) / np.linalg.norm(x, axis=1) / np.linalg.norm(v)
        order = sorted((round(float(a), 9), j) for j, a in enumerate(d) if not (skip_self and j == i))
        if within is not None:
            order = [o for o in order if o[0] < within]
        out[i] = order[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r["q_id"], []).append((round(r["distance"], 9), r["c_id"]))
    return out


@pytest.mark.parametrize("metric", ["sql2", "cosine"])
@pytest.mark.parametrize("block_rows", [None, 16])
def test_knn_is_exact_with_hot_copies(spark, metric, block_rows):
    x = vectors()
    q, c = frames(spark, x)
    got = found(neighbours.knn(q, c, 5, metric=metric, skip_self=True, block_rows=block_rows))
    want = brute(x, x, 5, metric, skip_self=True)
    assert got.keys() == want.keys()
    for i in want:
        np.testing.assert_allclose([d for d, _ in got[i]], [d for d, _ in want[i]], atol=1e-7)
        if metric == "sql2":
            assert [j for _, j in got[i]] == [j for _, j in want[i]]


def test_knn_within(spark):
    x = vectors()
    q, c = frames(spark, x)
    got = found(neighbours.knn(q, c, 1000, within=4.0, block_rows=16))
    want = {i: v for i, v in brute(x, x, 1000, "sql2", within=4.0).items() if v}
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}


def test_knn_small_and_empty(spark):
    x = vectors(n=3, copies=1)
    q, c = frames(spark, x)
    assert neighbours.knn(q, c, 10).count() == 9
    assert neighbours.knn(q, c.limit(0), 10).count() == 0
    assert neighbours.knn(q.limit(0), c, 10).count() == 0


def test_lsh_completed_is_exact_and_alone_is_not_far_off(spark):
    x = vectors(copies=20)
    q, c = frames(spark, x)
    want = brute(x, x, 5, "sql2", skip_self=True)
    options = dict(skip_self=True, bucket_length=4.0, block_rows=32)
    full = found(lsh.knn_lsh(q, c, 5, **options))
    assert {i: [j for _, j in v] for i, v in full.items()} == {i: [j for _, j in v] for i, v in want.items()}
    near = found(lsh.knn_lsh(q, c, 5, complete=False, **options))
    hits = sum(len({j for _, j in near.get(i, [])} & {j for _, j in want[i]}) for i in want)
    assert hits / (5 * len(want)) > 0.8


def _domains(df, id_col, name):
    return df.withColumn(name, F.concat(F.lit("m"), F.col(id_col) % 3, F.lit(".r"), F.col(id_col) % 4, F.lit(".example")))


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.85])
def test_bounded_route_equals_full_search(spark, threshold):
    x = vectors(n=150, copies=12, dim=4) / 6
    q, c = frames(spark, x)
    q, c = _domains(q, "q_id", "q_domain"), _domains(c, "c_id", "c_domain")
    config = EngineConfig(confidence_threshold=threshold, match_candidates=10)
    options = dict(query_id="q_id", index_id="c_id", query_domain="q_domain", candidate_domain="c_domain", config=config)
    full = similarity.match(q, c, **options).where(similarity.is_confident(F.col("confidence"), config))
    fast = similarity.match(q, c, confident_only=True, block_rows=16, **options)
    key = lambda df: sorted((r["q_id"], r["c_id"], round(r["confidence"], 9)) for r in df.collect())
    assert key(full) == key(fast)
    assert len(key(full)) > 0


@pytest.mark.parametrize("threshold, default, block_rows", [(0.5, 0.5, 16), (0.3, 0.3, 7), (0.85, 0.5, None), (0.3, 0.1, 16)])
def test_domain_first_equals_full_search(spark, threshold, default, block_rows):
    x = vectors(n=150, copies=12, dim=4) / 6
    q, c = frames(spark, x)
    names = ["a.example", "mail.a.example", "example", "x.b.example", "b.example", "org", "q.org", None, "", " B.example", "c.net"]
    named = lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.xxhash64(i), F.lit(len(names))) + 1).cast("int"))
    q, c = q.withColumn("q_domain", named("q_id")), c.withColumn("c_domain", named("c_id"))
    config = EngineConfig(confidence_threshold=threshold, default_domain_weight=default, match_candidates=5)
    options = dict(query_id="q_id", index_id="c_id", query_domain="q_domain", candidate_domain="c_domain", config=config)
    key = lambda df: sorted((r["q_id"], r["c_id"], round(r["confidence"], 9)) for r in df.collect())
    full = key(similarity.match(q, c, **options).where(similarity.is_confident(F.col("confidence"), config)))
    fast = similarity.match(q, c, confident_only=True, block_rows=block_rows, **options)
    assert key(fast) == full and len(full) > 0
    alone = similarity.match(q, c, confident_only=True, skip_self=True, **options)
    bounded = similarity.match(q, c, confident_only=True, skip_self=True, domain_first=False, **options)
    assert key(alone) == key(bounded)


def test_queries_travel_to_their_own_domains_only(spark):
    x = vectors(n=400, copies=1, dim=4)
    q, c = frames(spark, x)
    q, c = _domains(q, "q_id", "q_domain"), _domains(c, "c_id", "c_domain")
    left, right = (routing._keyed(a, b, d, e, "s:", "t:") for a, b, d, e in ((q, "q_domain", c, "c_domain"), (c, "c_domain", q, "q_domain")))
    dealt, blocks = neighbours.deal_blocks(left, right, ["_key"], "q_id", "c_id", 20)
    assert dealt.groupBy("q_id").agg(F.countDistinct("_key").alias("n")).where("n > 1").isEmpty()
    sizes = [r["n"] for r in blocks.where("_share = 0").groupBy("_key", "_block").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 45 and sum(sizes) == 400


def test_negative_similarity_prefers_the_lower_weight(spark):
    near = spark.createDataFrame([(1, 1, 2.0, "a.com", "a.com"), (1, 2, 2.0, "a.com", "b.com")],
                                 "q_id int, c_id int, distance double, q string, c string")
    best = similarity.best_match(similarity.score(near, "q", "c"), "q_id", "c_id").first()
    assert best["c_id"] == 2 and best["confidence"] == -0.5


def test_confidence_must_exceed_the_threshold(spark):
    df = spark.createDataFrame([(0.85,), (0.8500001,)], "c double")
    assert [r[0] for r in df.select(similarity.is_confident(F.col("c"))).collect()] == [False, True]


def test_match_stats(spark):
    df = spark.createDataFrame([(0.9, 0.9, "a"), (0.5, 1.0, None)], "confidence double, similarity double, d string")
    assert tuple(similarity.match_stats(df).first()) == (2, 1, 0.7, 0.95)
    assert tuple(similarity.match_stats(df.limit(0)).first()) == (0, 0, 0.0, 0.0)
    assert {tuple(r) for r in similarity.match_domains(df, "d").collect()} == {("a", 1), ("unknown", 1)}


def test_lookup_join_with_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    left = left.withColumn("k", F.when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("k")))
    right = left.select("k").distinct().where("k is not null").withColumn("v", F.concat(F.lit("v"), F.col("k")))
    plain = left.join(right, "k", "left")
    hot = lookup_join(left, right, "k", hot_share=0.1, hot_rows=10)
    key = lambda df: sorted((r["id"], r["k"] or "", r["v"] or "") for r in df.collect())
    assert key(hot) == key(plain)


def test_rules_priority_and_default(spark):
    rows = ["big SALE and order", "your order", "celebrate", "help", "hello", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(classify.classify_rules(F.col("c"))).collect()]
    assert got == ["marketing", "transactional", "survey", "customer_support", "personal", "personal"]
    whole = [r[0] for r in df.orderBy("i").select(classify.classify_rules(F.col("c"), whole_word=True)).collect()]
    assert whole[2] == "personal"


GOOD = '{"email_category":"survey","business_entity":{"name":"A","website":"https://a.com"},"data":{},"confidence_score":0.9}'


@pytest.mark.parametrize(("reply", "valid"), [
    (GOOD, True), ("```json\n" + GOOD + "\n```", True), ("not json", False), (None, False),
    (GOOD.replace("survey", "other"), False), (GOOD.replace("0.9", "1.2"), False),
    (GOOD.replace("https://a.com", "a.com"), False), (GOOD.replace('"name":"A",', ""), False),
])
def test_parse_reply(spark, reply, valid):
    row = spark.createDataFrame([(reply,)], "r string").select(classify.parse_reply(F.col("r")).alias("p")).first()
    assert (row["p"] is not None) == valid


def test_model_is_asked_once_per_prompt_and_failures_fall_back(spark):
    df = spark.createDataFrame(
        [(i, "same text" if i % 2 else "boom", "x.com", None, ["https://x.com"]) for i in range(6)],
        "id int, body string, sender_domain string, footer_text string, urls array<string>")

    def model(prompts):
        assert prompts.is_unique
        return [None if "boom" in p else GOOD for p in prompts]

    got = classify.classify_with_model(df, model, "body").orderBy("id").collect()
    assert [r["result"]["email_category"] for r in got] == ["personal", "survey"] * 3
    assert [r["result"]["confidence_score"] for r in got] == [0.3, 0.9] * 3
    assert got[0]["result"]["business_entity"]["website"] == "https://x.com"


@pytest.mark.parametrize("name, n, dim", [("given", 500, 64), ("given", 2000, 64), ("clusters", 3000, 16), ("clusters", 24_000, 16), ("even", 6000, 8)])
def test_recall_of_default_parameters(spark, name, n, dim):
    if name == "given":
        rows = spark.read.parquet(f"/root/testdata/sf{0.01 if n == 500 else 0.1}/embeddings.parquet").limit(n).collect()
        x = np.array([r.embedding for r in rows])
    elif name == "clusters":
        x = vectors(seed=n, n=n, dim=dim, copies=50, centres=40)
    else:
        x = np.random.default_rng(4).random((n, dim))
    asked = x[:: max(1, n // 500)]
    q, c = frames(spark, x, asked)
    near = found(lsh.knn_lsh(q, c, 5, complete=False))
    hits = 0
    for i, v in enumerate(asked):
        d = ((x - v) ** 2).sum(axis=1)
        limit = np.sort(d)[4] * (1 + 1e-6) + 1e-9  # of equal distances, any will do
        hits += sum(d[j] <= limit for _, j in near.get(i, []))
    assert hits / (5 * len(asked)) >= 0.9


def test_probes_are_distinct_and_nearest_first():
    for width in (1, 2, 5):
        sets = lsh.shift_sets(width, 60)
        assert sets[0] == () and len(set(sets)) == len(sets) == min(60, 3 ** width)
        model = lsh._drawn(6, 1.0, 3, width, False, 1)
        x = np.random.default_rng(2).normal(size=(20, 6))
        probed = model.probed(x, sets)
        assert (probed[:, :, 0] == model.own(x)).all()
        assert all(len(set(row)) == len(sets) for table in probed for row in table)
