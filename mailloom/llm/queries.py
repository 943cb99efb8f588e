"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import (
    centroids, collocations, exact_dedup, html_text, mixing, packing, pii, quality, rules, simhash, substrings, suffix_tree,
    warc,
)
from mailloom.llm.common import new_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as an archive, read it back: payload length and digest, type and referred page of each."""
    path = new_path(spark, "archive")
    warc.write_archive(table(spark, folder, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.lower(F.hex("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of all documents without their repeated windows of 20 words."""
    return substrings.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.lower(F.hex("kept_digest")).alias("kept_sha256"))


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents; rows held out of training are marked."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return quality.score(docs, table(spark, folder, "labels")).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document the mix of all documents takes."""
    return mixing.mix(table(spark, folder, "documents")).takes()


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies over all documents; of equal texts the largest doc_id stays."""
    return exact_dedup.dedup(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule figures and verdict of all documents."""
    return rules.verdicts(table(spark, folder, "documents"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.report(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    return collocations.top(table(spark, folder, "documents")).drop("k")


def op12_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a suffix tree over the words of those that aren't held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_tree.score(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2)


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds."""
    return centroids.report(table(spark, folder, "embeddings"))


def clusters_sql(rounds: int = 3) -> str:
    """Rounds of assignment and means, written out one after the other."""
    def near(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
            SELECT vec_id, x, min(d * 16 + k) % 16 AS k, min(d) AS d
            FROM (SELECT v.vec_id, v.row, v.x, m.k, list_sum(list_transform(
                    list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d
                FROM v, m{i} m)
            GROUP BY row, vec_id, x)"""

    def means(i: int) -> str:
        return f"""m{i + 1} AS MATERIALIZED (
            SELECT m.k, coalesce(s.x, m.x) AS x
            FROM m{i} m LEFT JOIN (
                SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY place) AS x
                FROM (SELECT k, place, sum(c) AS t, count(*) AS n
                    FROM (SELECT k, unnest(x) AS c, unnest(range(64)) AS place FROM a{i}) GROUP BY k, place)
                GROUP BY k) s ON m.k = s.k)"""

    steps = ", ".join(f"{near(i)}, {means(i)}" for i in range(rounds))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS row,
                list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
        m0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x FROM v
            ORDER BY k LIMIT 16),
        {steps}, {near(rounds)}
        SELECT vec_id, a.k::INTEGER AS cluster, d::BIGINT AS distance,
            (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(m.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN m{rounds} m ON a.k = m.k"""


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_substrings": op3_substrings,
    "op4_html_text": op4_html_text,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_rules": op8_rules,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_lm": op12_lm,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                sha256(coalesce(html, '')) AS payload_digest,
                min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p""",
    "op3_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        places AS MATERIALIZED (
            SELECT doc_id, unnest(list_transform(range(1, len(words) - 18),
                lambda i: {'i': i, 'h': sha256(array_to_string(words[i:i + 19], ' '))}), recursive := true) FROM d),
        again AS (
            SELECT doc_id, i FROM places
            QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(20)) AS k)),
        w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
        kept AS (
            SELECT w.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY w.i) AS kept
            FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT lang, row_number() OVER () AS row, regexp_extract_all(piece, '[^\x20\x09]+') AS words
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents)),
        places AS (
            SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3, lead(w1, 3) OVER piece AS w4
            FROM (SELECT lang, row, unnest(words) AS w1, unnest(range(len(words))) AS i FROM pieces)
            WINDOW piece AS (PARTITION BY row ORDER BY i)),
        f AS MATERIALIZED (
            SELECT lang, [w1] AS p, 1 AS k, count(*) AS a FROM places GROUP BY lang, w1
            UNION ALL SELECT lang, [w1, w2], 2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
            UNION ALL SELECT lang, [w1, w2, w3], 3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
            UNION ALL SELECT lang, [w1, w2, w3, w4], 4, count(*) FROM places WHERE w4 IS NOT NULL
                GROUP BY lang, w1, w2, w3, w4),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
        inside AS (
            SELECT lang, p[i:i + m - 1] AS part, max(a) AS most
            FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k
            GROUP BY ALL),
        cuts AS (
            SELECT c.lang, c.p, c.k, c.a, s.cut, l.a AS l, r.a AS r,
                ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
            FROM c JOIN (SELECT unnest([1, 2, 3]) AS cut) s ON s.cut < c.k
            JOIN f l ON l.lang = c.lang AND l.p = c.p[1:s.cut]
            JOIN f r ON r.lang = c.lang AND r.p = c.p[s.cut + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
        kept AS (
            SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.p
            WHERE i.most IS NULL OR 100 * i.most < 80 * b.a)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000""",
    "op13_centroids": clusters_sql(),
}
