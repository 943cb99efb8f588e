"""Exact dedup and the WARC archive against brute force."""

import hashlib

import pytest
from pyspark.errors.exceptions.base import PySparkException

from mailloom.llm import exact_dedup, warc


def groups(rows):
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    return by_text


@pytest.mark.parametrize("keep, fan_in", [("largest", 8), ("smallest", 2)])
def test_copies(awkward, keep, fan_in):
    rows, found = awkward.collect(), exact_dedup.dedup(awkward, keep=keep, fan_in=fan_in).collect()
    assert len(found) == len(rows)
    best = max if keep == "largest" else min
    want = {}
    for text, ids in groups(rows).items():
        real = [i for i in ids if i is not None]
        want[hashlib.sha256(text.encode()).digest()] = (best(real) if real else None, len(ids))
    for r in found:
        assert (r.keep_id, r.group_size) == want[bytes(r.digest)]
    kept = [bytes(r.digest) for r in found if r.kept]
    assert sorted(kept) == sorted(want)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_survivors_are_one_row_per_text_with_all_columns(awkward):
    found = exact_dedup.survivors(awkward)
    assert found.columns == awkward.columns
    assert sorted(r.text or "" for r in found.collect()) == sorted(groups(awkward.collect()))


def test_nothing(nothing):
    assert exact_dedup.dedup(nothing).count() == 0
    assert exact_dedup.survivors(nothing).count() == 0


def pages(spark):
    rows = [(1, "u1", "a" * 200), (2, "u2", "a" * 200), (3, "u\r\n3", "short"), (4, None, "short"), (5, "u5", None),
            (6, "u6", ""), (None, "u7", "a" * 200), (8, "u8", "é" * 50), (9, "u9", "é" * 50), (10, "x", "\r\n\r\nWARC/1.1"),
            (1, "u1", "a" * 200), (11, "x", "é" * 49 + "a"), (12, "x", "é" * 49 + "a")]
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, digest string, n_bytes int")


def test_archive_round_trip(spark, tmp_path):
    table = pages(spark).repartition(3)
    warc.write_archive(table, f"{tmp_path}/a")
    found = warc.read_archive(spark, f"{tmp_path}/a").collect()
    assert len(found) == table.count()
    assert sorted(bytes(r.payload) for r in found) == sorted((r.html or "").encode() for r in table.collect())
    by_id = {}
    for r in found:
        by_id.setdefault(r.page_id, []).append(r)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.type.encode())
        assert rest == (bytes(r.payload) if r.type == "response" else b"") + b"\r\n\r\n"
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert length == len(rest) - 4
        assert hashlib.sha256(bytes(r.payload)).digest() == bytes(r.digest)
    assert sorted(r.type for r in by_id[1]) == ["response", "revisit"]  # a repeated row is a revisit of the first
    assert [(r.type, r.refers_to) for r in by_id[2] + by_id[None]] == [("revisit", 1)] * 2
    assert [r.type for r in by_id[3] + by_id[4] + by_id[5] + by_id[6]] == ["response"] * 4
    assert [(r.type, r.refers_to) for r in by_id[8] + by_id[9]] == [("response", None), ("revisit", 8)]
    assert [r.type for r in by_id[11] + by_id[12]] == ["response", "response"]  # 99 bytes
    payloads = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert payloads.count() == payloads.select("digest").distinct().count() == 6


def test_damaged_payload_is_noticed(spark, tmp_path):
    warc.write_archive(pages(spark), f"{tmp_path}/b")
    bad = spark.read.parquet(f"{tmp_path}/b/payloads").selectExpr("digest", "cast('other' as binary) payload")
    bad.write.parquet(f"{tmp_path}/c/payloads")
    spark.read.parquet(f"{tmp_path}/b/headers").write.parquet(f"{tmp_path}/c/headers")
    with pytest.raises(PySparkException, match="doesn't match its digest"):
        warc.read_archive(spark, f"{tmp_path}/c").collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(pages(spark).filter("false"), f"{tmp_path}/d")
    assert warc.read_archive(spark, f"{tmp_path}/d").count() == 0
