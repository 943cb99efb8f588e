"""What must not grow with the input: rows that a search sends, batches, files of messages, state calls."""

import json
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from mailloom.operators import neighbours
from mailloom.operators.skew import shared_folder
from mailloom.plans import catalog
from mailloom.sources import messages as source
from mailloom.streaming import retries


def vectors(spark, n, dim=8):
    x = np.random.default_rng(5).normal(size=(n, dim))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "q_id long, q_vec array<double>"), spark.createDataFrame(rows, "c_id long, c_vec array<double>"), x


def search(spark, monkeypatch, **options):
    """(neighbours, query rows that were sent) of a search over 400 vectors."""
    q, c, x = vectors(spark, 400)
    sent, inner = [], neighbours.block_neighbours

    def spy(queries, *args, **kwargs):
        sent.append(queries.count())
        return inner(queries, *args, **kwargs)

    monkeypatch.setattr(neighbours, "block_neighbours", spy)
    got = {}
    for r in neighbours.knn(q, c, 5, skip_self=True, **options).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["c_id"])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {i: list(map(int, np.argsort(row)[:5])) for i, row in enumerate(d)}
    return sent[0]


def test_many_small_cells_get_a_query_once(spark, monkeypatch):
    assert search(spark, monkeypatch, block_rows=4) == 400


def test_bundles_and_shares_of_bounded_size(spark, monkeypatch):
    assert 400 < search(spark, monkeypatch, block_rows=4, bundle_rows=50) <= 400 * 16


def test_bundles_hold_all_cells_within_their_bound():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(0, 40, 60)
    sizes[7] = 950
    bundle, blocks, order = neighbours.bundles(rnd.normal(size=(60, 3)), sizes, 100)
    held = np.bincount(bundle, sizes)
    assert sorted(order) == list(range(60)) and (np.diff(bundle[order]) >= 0).all()
    assert (held <= 100 * blocks).all() and blocks[bundle[7]] == 10 and (blocks[held <= 100] == 1).all()


def test_a_task_sends_bounded_batches():
    batch = pa.RecordBatch.from_arrays([pa.array([[float(i)] * 64 for i in range(500)])], ["v"])
    row = np.repeat(np.arange(500), 200)
    parts = list(neighbours.copies(batch, row, {"_cell": np.arange(len(row))}))
    assert max(p.nbytes for p in parts) < 1.2 * neighbours.SENT_BYTES
    assert [v for p in parts for v in p["_cell"].to_pylist()] == list(range(len(row)))
    assert parts[-1]["v"][-1].as_py() == [499.0] * 64


def of_brute_force(x, q, ids, k):
    d = ((q[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    return [list(ids[np.lexsort((ids, row))[:k]]) for row in d]


def test_blocks_of_vectors_are_worked_on_in_tiles():
    """A block's vectors aren't copied whole, and what the work takes beside them doesn't grow with the block."""
    x = np.random.default_rng(6).normal(size=(60_000, 64)).astype(np.float32)
    x[40_000:] = x[:20_000]
    held = []
    for n in (10_000, 60_000):
        ids, asked = np.arange(n)[::-1].copy(), x[:n:2500]
        tracemalloc.start()
        qi, ci, d, rank = neighbours.nearest_rows(asked, x[:n], -1 - np.arange(len(asked)), ids, 3, "sql2", None, False)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert list(rank) == [1, 2, 3] * len(asked) and (d[rank == 1] == 0).all()
        got = ids[ci].reshape(-1, 3)
        assert [list(r) for r in got[:4]] == of_brute_force(x[:n], asked[:4], ids, 3)
    assert held[1] - held[0] < x[10_000:].nbytes / 2


def test_tiles_give_what_one_matrix_gives(monkeypatch):
    x = np.round(np.random.default_rng(8).normal(size=(300, 3)), 1).astype(np.float32)  # with copies and ties
    ids = np.random.default_rng(9).permutation(300)
    seen = []
    for tile, cells, hashes in ((300, 1 << 19, None), (7, 50, None), (7, 50, lambda words: words[:, 0] % 5)):
        monkeypatch.setattr(neighbours, "TILE_ROWS", tile)
        monkeypatch.setattr(neighbours, "CHUNK_CELLS", cells)
        if hashes:  # different rows of one hash aren't taken for equal
            monkeypatch.setattr(neighbours, "row_hashes", hashes)
        for metric, within in (("sql2", None), ("sql2", 0.05), ("cosine", None), ("cosine", 0.001)):
            qi, ci, d, rank = neighbours.nearest_rows(x, x, ids, ids, 4, metric, within, True)
            seen.append((metric, within, list(qi), list(ids[ci]), list(d), list(rank)))
    assert seen[:4] == seen[4:8] == seen[8:]
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert np.reshape(seen[0][3], (300, 4)).tolist() == [list(ids[np.lexsort((ids, row))[:4]]) for row in d]


def test_a_task_of_the_search_needs_one_python_worker(spark):
    """Finding an index row's cell and sending it on are one step, not two workers that stand behind each other."""
    q, c, _ = vectors(spark, 400)
    plan = neighbours.knn(q, c, 5, block_rows=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one for queries, one for the index


def test_cells_are_found_in_bounded_steps():
    x = np.random.default_rng(7).normal(size=(20_000, 8)).astype(np.float32)
    column, pivots = pa.array(list(x)), x[:1000].astype(float)
    tracemalloc.start()
    cell, near = neighbours.homes(column, pivots, False)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 3 * 8 * neighbours.CHUNK_CELLS
    assert list(cell[:1000]) == list(range(1000)) and near[:1000].max() < 1e-6
    d = ((x[1000:1100, None].astype(float) - pivots) ** 2).sum(2)
    assert list(cell[1000:1100]) == list(d.argmin(1)) and np.allclose(near[1000:1100], np.sqrt(d.min(1)))


def documents(spark, folder, n=60):
    rows = [(i, f"mail a{i}@b.com now", "en", f"src{i % 4}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_a_table_of_one_or_several_files_is_streamed(spark, tmp_path):
    sf = documents(spark, tmp_path / "folder")
    os.mkdir(tmp_path / "file")
    pq.write_table(pq.read_table(f"{sf}/documents.parquet"), f"{tmp_path}/file/documents.parquet")
    for at in (sf, f"{tmp_path}/file"):
        got = catalog.stream_values(spark, at)
        assert sorted(r["value"] for r in got.collect()) == sorted(f"a{i}@b.com" for i in range(60))


def test_intake_files_grow_with_the_table(spark, tmp_path):
    def folders():
        return {x for x in os.listdir(shared_folder(spark)) if x.startswith("intake-")}

    sf, before, bound = documents(spark, tmp_path), folders(), "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(bound)
    spark.conf.set(bound, "500b")
    try:
        got = catalog.stream_intake(spark, sf).collect()
        splits = catalog._docs(spark, sf).rdd.getNumPartitions()
    finally:
        spark.conf.set(bound, old)
    assert sorted(r["email_id"] for r in got) == list(range(60)) and splits > 3
    work = f"{shared_folder(spark)}/{(folders() - before).pop()}"
    assert sum(x.endswith(".parquet") for x in os.listdir(f"{work}/raw")) > 3
    assert sorted(x for x in os.listdir(f"{work}/queued")) == ["batch=0", "batch=1", "batch=2"]


def test_files_do_not_grow_with_their_messages(spark, tmp_path):
    def files():
        return sum(len(names) for at, _, names in os.walk(shared_folder(spark)) if "/files-" in at)

    rows = [(i, f"https://h{i % 7}.example/p", f"<p>{i}</p>") for i in range(80)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    before = files()
    got = catalog.labelled_files(spark, str(tmp_path)).collect()
    assert len(got) == 80 and {r["from_email"] for r in got} == {f"news@h{i}.example" for i in range(7)}
    assert files() - before < 40


def test_packed_messages_read_like_files(spark, tmp_path):
    names = ["email_01_survey_a_com.json", "email_2_b_net.json", "email_3_personal_c_org.json", "email_4_d_de.json"]
    rows = [(n, json.dumps({"from": f"x@{i}.de", "subject": n, "html_content": "h"})) for i, n in enumerate(names)]
    rows[3] = (names[3], "no json")
    os.mkdir(tmp_path / "in")
    for name, raw in rows:
        (tmp_path / "in" / name).write_text(raw)
    source.pack_messages(spark.createDataFrame(rows, "source_file string, raw string"), f"{tmp_path}/packed")
    seen = []
    for path, packed in (("in", False), ("packed", True)):
        good, bad = source.read_emails(spark, f"{tmp_path}/{path}", packed=packed)
        labelled = source.label_from_filename(good).drop("source_file", "email_id")
        seen.append((sorted(map(str, labelled.collect())), [r["error"] for r in bad.collect()]))
    assert seen[0] == seen[1] and len(seen[0][0]) == 3 and len(seen[0][1]) == 1


def test_failures_are_held_by_bucket(spark, tmp_path, monkeypatch):
    """Many failures of one batch share few keys of the state, and still come again one by one."""
    monkeypatch.setattr(retries, "BUCKETS", 3)
    work, queue = str(tmp_path / "work"), str(tmp_path / "queue")
    rows = spark.createDataFrame([(f"m{i}", str(i % 3)) for i in range(300)], "source_file string, raw string")
    rows.coalesce(1).write.parquet(queue)
    new = spark.readStream.schema("source_file string, raw string").parquet(queue)
    fails = lambda batch, _: batch.withColumn("error", F.when(F.col("attempt") <= F.col("raw").cast("int"), F.lit("no")))
    query = retries.with_retries(new, fails, work, pause=0.5, interval="100 milliseconds")
    retries.finish(query, work, patience=200)
    got = {(r["source_file"], r["attempt"]) for r in retries.attempts(spark, work).collect()}
    assert got == {(f"m{i}", a) for i in range(300) for a in range(1, i % 3 + 2)}
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) <= 200
