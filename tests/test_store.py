from pyspark.sql import functions as F

from mailloom.operators import reports, store


def results(spark, rows):
    df = spark.createDataFrame(rows, "id int, sender_domain string, at string, email_category string, confidence_score double")
    return df.withColumn("processed_at", F.col("at").cast("timestamp")).drop("at")


ROWS = [
    (1, "a.com", "2024-01-01 00:00:00", "survey", 0.9), (2, "a.com", "2024-01-02 00:00:00", "survey", 0.8),
    (3, "a.com", "2024-01-03 00:00:00", "personal", 0.5), (4, "b.com", "2024-01-02 00:00:00", None, 0.05),
    (5, None, "2024-01-02 00:00:00", "survey", 1.0),
]


def ids(df):
    return [r["id"] for r in df.collect()]


def test_domain_query_bounds_are_inclusive(spark):
    r = results(spark, ROWS)
    assert ids(store.query_by_domain(r, "a.com")) == [3, 2, 1]
    assert ids(store.query_by_domain(r, "a.com", start="2024-01-01 00:00:00", end="2024-01-02 00:00:00")) == [2, 1]
    assert ids(store.query_by_domain(r, "a.com", limit=1, end="2024-01-02 00:00:00")) == [2]
    assert ids(store.query_by_domain(r, "a.com", limit=1, end="2024-01-02 00:00:00", strict=True)) == []
    assert ids(store.query_by_domain(r, "zz")) == [] and ids(store.query_by_domain(r.limit(0), "a.com")) == []
    assert ids(store.get_result(r, 4)) == [4] and ids(store.get_result(r, 99)) == []


def test_latest_per_domain(spark):
    got = {(r["sender_domain"], r["id"]) for r in store.latest_per_domain(results(spark, ROWS), 2).collect()}
    assert got == {("a.com", 3), ("a.com", 2), ("b.com", 4), (None, 5)}


def test_statistics(spark):
    got = {(r["section"], r["name"]): r["value"] for r in store.result_stats(results(spark, ROWS)).collect()}
    assert got[("total", "results")] == 5 and got[("category", "unknown")] == 1 and got[("domain", "unknown")] == 1
    assert got[("mean", "confidence_score")] == 0.65
    empty = {(r["section"], r["name"]): r["value"] for r in store.result_stats(results(spark, ROWS).limit(0)).collect()}
    assert empty == {("total", "results"): 0.0, ("mean", "confidence_score"): 0.0}


def test_top_domains_break_ties_by_name(spark):
    rows = [(i, f"d{i:02}.com", "2024-01-01 00:00:00", "survey", 0.5) for i in range(12)]
    top = [r["sender_domain"] for r in store.top_domains(results(spark, rows)).collect()]
    assert top == [f"d{i:02}.com" for i in range(10)]


def test_mean_rounds_half_even(spark):
    df = spark.createDataFrame([(0.8125,)], "c double")
    assert df.agg(store.rounded_mean("c")).first()[0] == 0.812


def test_floats_become_decimals_wherever_they_are(spark):
    df = spark.sql("select 1 as i, 0.25d as x, named_struct('a', 0.5d, 'b', 'double', 'c', array(1.5f)) as s, array(0.125d) as l")
    done = store.floats_to_decimal(df)
    assert done.schema.simpleString() == (
        "struct<i:int,x:decimal(18,6),s:struct<a:decimal(18,6),b:string,c:array<decimal(18,6)>>,l:array<decimal(18,6)>>")
    assert float(done.first()["s"]["a"]) == 0.5


def test_reports(spark):
    r = results(spark, ROWS).withColumn("processing_time", F.col("id").cast("double"))
    shares = {x["email_category"]: (x["results"], x["percent"]) for x in reports.category_shares(r).collect()}
    assert shares == {"survey": (3, 60.0), "personal": (1, 20.0), None: (1, 20.0)}
    summary = reports.run_summary(r).first()
    assert (summary["min_confidence"], summary["max_time"], summary["results"]) == (0.05, 5.0, 5)
    assert sorted(ids(reports.high_confidence(r))) == [1, 5]
    assert tuple(reports.high_confidence_count(r).first()) == (2, 5)
    assert reports.latency_check(r).first()["passed"] is True
    slow = reports.latency_check(r.withColumn("processing_time", F.lit(10.0))).first()
    assert slow["too_slow"] == 5 and slow["passed"] is False


def test_evaluation(spark):
    p = spark.createDataFrame(
        [(1, "m", "survey", 0.9), (2, "m", "personal", 0.7), (1, "n", "personal", 0.5), (2, "n", "survey", 0.5)],
        "id int, model string, predicted string, confidence double")
    labels = spark.createDataFrame([(1, "survey"), (2, "personal")], "id int, expected string")
    assert [(r["model"], r["accuracy"]) for r in reports.accuracy_by_model(p, labels, "id").collect()] == [("m", 1.0)]
    both = {r["model"]: r["accuracy"] for r in reports.accuracy_by_model(p, labels, "id", accepted_only=False).collect()}
    assert both == {"m": 1.0, "n": 0.0}
    per_class = {r["category"]: (r["precision"], r["recall"]) for r in reports.class_precision(reports.confusion(p, labels, "id")).collect()}
    assert per_class["survey"] == (0.5, 0.5) and per_class["marketing"] == (None, None)


def test_providers(spark):
    rows = [("x", True, "survey", 0.9, 2.0), ("y", True, "survey", 0.9, 1.0), ("z", True, None, None, None), ("w", False, "survey", 1.0, 0.1)]
    p = spark.createDataFrame(rows, "provider string, success boolean, category string, confidence double, processing_time double")
    assert [r["provider"] for r in reports.rank_providers(p).orderBy("rank").collect()] == ["y", "x", "z"]
    assert {tuple(r) for r in reports.providers_by_category(p).collect()} == {("survey", "x, y", 2), ("unknown", "z", 1)}
