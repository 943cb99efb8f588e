"""Batches against earlier batches, replies kept across runs, pruned look-ups, statistics from one scan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailloom.operators import batches, classify, store
from mailloom.sources import messages as source
from mailloom.sources import results as sink


def plan_of(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("block_rows, most", [(None, 3), (16, 13)])
def test_batches_meet_earlier_ones_only(spark, block_rows, most):
    rng = np.random.default_rng(most)
    x = rng.normal(size=(260, 4))
    x[:60] = x[0]
    batch = rng.integers(0, most, len(x))
    rows = [(i, [float(v) for v in r], int(b)) for i, (r, b) in enumerate(zip(x, batch))]
    q = spark.createDataFrame([*rows, (900, rows[1][1], None)], "q_id long, q_vec array<double>, q_batch int")
    c = spark.createDataFrame([*rows, (900, rows[1][1], None)], "c_id long, c_vec array<double>, c_batch long")
    got = {}
    for r in batches.earlier_neighbours(q, c, 4, block_rows=block_rows).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["c_id"])
    for i, v in enumerate(x):
        d = ((x - v) ** 2).sum(axis=1)
        order = [int(j) for j in np.lexsort((np.arange(len(x)), d)) if batch[j] < batch[i]][:4]
        assert got.get(i, []) == order
    assert 900 not in got
    assert batches.earlier_neighbours(q.limit(0), c, 4).count() == 0
    assert batches.earlier_neighbours(q, c.limit(0), 4).count() == 0


def test_no_prompt_is_asked_twice_over_runs(spark, tmp_path):
    log, kept = tmp_path / "asked", str(tmp_path / "replies")
    log.mkdir()
    down = tmp_path / "down"
    down.write_text("")

    def model(prompts):
        import uuid
        if down.exists() and prompts.str.contains("bad").any():
            raise ValueError("not reached")
        (log / uuid.uuid4().hex).write_text("\n".join(prompts))
        return pd.Series([f"re {p}" for p in prompts])

    def asked():
        return sorted(x for f in log.iterdir() for x in f.read_text().split("\n"))

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "bad", "a"])], "i int, p string")
    run = lambda d: {r["i"]: r["r"] for r in classify.call_model(d, "p", "r", model, kept).collect()}
    assert run(df) == {0: "re a", 1: "re b", 2: None, 3: "re a"} and asked() == ["a", "b"]
    state = {r["_key"]: (r["reply"], r["attempts"]) for r in classify.kept_replies(spark, kept).collect()}
    assert (None, 4) in state.values()
    assert run(df.where("p <> 'bad'")) == {0: "re a", 1: "re b", 3: "re a"} and asked() == ["a", "b"]
    down.unlink()
    more = df.unionByName(spark.createDataFrame([(9, "c")], "i int, p string"))
    assert run(more) == {0: "re a", 1: "re b", 2: "re bad", 3: "re a", 9: "re c"}
    assert asked() == ["a", "b", "bad", "c"]
    assert run(more)[2] == "re bad" and asked() == ["a", "b", "bad", "c"]


def test_prompts_that_always_fail_are_given_up(spark, tmp_path):
    def model(prompts):
        raise ValueError("down")

    df = spark.createDataFrame([(1, "x")], "i int, p string")
    counts = []
    for _ in range(4):
        classify.call_model(df, "p", "r", model, str(tmp_path / "r"), most_attempts=8).collect()
        counts.append(classify.kept_replies(spark, str(tmp_path / "r")).first()["attempts"])
    assert counts == [4, 8, 8, 8]


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.range(3000).select(
        "id", F.concat(F.lit("d"), F.col("id") % 7 * (F.col("id") % 3), F.lit(".com")).alias("sender_domain"),
        (F.lit(1704067200) + (F.col("id") * 7919 % 3000) * 1728).cast("timestamp").alias("processed_at"),
        F.when(F.col("id") % 5 > 0, "survey").alias("email_category"), (F.col("id") % 10 / 10).alias("confidence_score"))
    sink.append_results(rows.withColumn("dt", F.to_date("processed_at")), str(tmp_path / "r"), id_parts=5)
    return rows, sink.read_results(spark, str(tmp_path / "r"))


def test_a_look_up_reads_one_folder_a_day(stored):
    rows, table = stored
    for key in (0, 77, 2999):
        found = store.get_result(table, key, id_parts=5)
        assert [r["id"] for r in found.collect()] == [key]
    assert store.get_result(table, 99999, id_parts=5).count() == 0
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(id_part" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,2999)]" in plan
    assert len(found.inputFiles()) > 0 and table.count() == 3000


def test_newest_of_a_domain(stored):
    rows, table = stored
    for domain, limit in (("d0.com", 5), ("d12.com", 40), ("d2.com", 1), ("d4.com", 10_000), ("none", 3)):
        want = [r["id"] for r in rows.where(F.col("sender_domain") == domain).orderBy(F.col("processed_at").desc(), "id").limit(limit).collect()]
        found = store.newest_of_domain(table, domain, limit)
        assert [r["id"] for r in found.collect()] == want
    few = store.newest_of_domain(table, "d0.com", 5)
    last = rows.agg(F.max(F.to_date("processed_at"))).first()[0]
    assert str(last) in plan_of(few)  # only the last day is read
    assert few.agg(F.min(F.to_date("processed_at"))).first()[0] == last
    assert store.newest_of_domain(table.limit(0), "d0.com", 5).count() == 0


def test_statistics_take_one_scan(stored):
    rows, table = stored
    plan = plan_of(store.result_stats(table))
    assert plan.split("\n\n\n")[0].count("Scan parquet") == 1
    got = {(r["section"], r["name"]): r["value"] for r in store.result_stats(table).collect()}
    domains = {r["sender_domain"]: r["n"] for r in rows.groupBy("sender_domain").agg(F.count("*").alias("n")).collect()}
    best = sorted(domains.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert {k[1]: v for k, v in got.items() if k[0] == "domain"} == dict(best)
    assert got["total", "results"] == 3000 and got["category", "unknown"] == 600 and got["mean", "confidence_score"] == 0.45
    sampled = {(r["section"], r["name"]): r["value"] for r in store.result_stats(table, sample_limit=10).collect()}
    assert sampled["total", "results"] == 3000 and sum(v for k, v in sampled.items() if k[0] == "category") == 10


def test_labels_from_folder_names(spark):
    names = ["/x/email_01_survey_a_com.json", "/x/email_01_survey_a_com.json/part-0.txt", "/x/email_7_b_net.JSON/part-1", "/x/y.json"]
    df = spark.createDataFrame([(n,) for n in names], "source_file string")
    got = [tuple(r)[1:] for r in source.label_from_filename(df).collect()]
    assert got == [("survey", "a.com"), ("survey", "a.com"), (None, "b.net"), (None, None)]
