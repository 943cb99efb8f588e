"""The pipeline, stage by stage, and every query of the subpackage."""

import corpus_pipeline
import pytest

from mailloom.llm import queries
from mailloom.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    names, before = docs.columns, {tuple(r) for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), name.replace(" ", "_"))
        rows = [tuple(r) for r in docs.collect()]
        assert docs.columns == names and rows
        assert set(rows) <= before
        if name != "mixing":
            assert len(rows) == len(set(rows))
            before = set(rows)
        seen.append(len(rows))
    assert seen[0] < 200 and seen[1] < seen[0]
    texts = [r[names.index("text")] for r in before]
    assert len(texts) == len(set(texts))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(r.start == 0 for r in packed) == seen[-1]


def test_run_gives_the_rows_of_its_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "stage")
    assert sorted(rows) == sorted(docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect())


#: Queries with a row per row of another table than documents, and the one whose rows are phrases.
OTHERS = {"op2_warc": ("pages", "page_id"), "op4_html_text": ("pages", "page_id"), "op13_centroids": ("embeddings", "vec_id")}
PHRASES = "op11_collocations"


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != PHRASES])
def test_queries_answer_every_row(spark, name):
    kind, key = OTHERS.get(name, ("documents", "doc_id"))
    found = queries.QUERIES[name](spark, FOLDER)
    assert found.select(key).distinct().count() == table(spark, FOLDER, kind).count()


def test_phrases_are_ranked_in_each_language(spark):
    ranks = {}
    for r in queries.QUERIES[PHRASES](spark, FOLDER).collect():
        ranks.setdefault(r["lang"], []).append(r["rank"])
    assert ranks and all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 2000 for x in ranks.values())
