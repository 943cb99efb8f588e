import pytest

SCHEMA = "doc_id long, text string, source string, score double, kept boolean, slot int, digest string, n long, row long, _id long, _key long, _row string, bytes int"


@pytest.fixture(scope="session")
def small_batches(spark):
    """Arrow batches of a few rows, so that groups cross them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="session")
def awkward(spark, small_batches):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    words = [f"w{i % 977}x{i % 13}" for i in range(40_000)]
    texts = [
        None, "", " \t\n", "one", "one two", "One TWO three", "one two three", "a b c d e f g h i j " * 4,
        " ".join(words), " ".join(words[:5000]) + "\n" + " ".join(words[:300]), "x" * 50_000, "é ß 日本 \x00 \x85 😀",
        "line one is here.\nline one is here.\nline two", "mail a@b.example or +1 212 555 0143, 4111 1111 1111 1111",
        " ".join(words[100:140]), "pre " + " ".join(words[100:140]) + " post", " ".join(words[700:1500]),
    ]
    rows = [(i if i % 11 else None, texts[i % len(texts)], (None, "s1", "s2", "", "s1")[i % 5]) for i in range(120)]
    rows += rows[20:35] + [(3, "another text under three", "s1"), (None, None, None), (None, "one", "s2")]
    return spark.createDataFrame([(*r, 0.5, True, 1, "d", 7, 3, 1, 2, "r", 4) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
