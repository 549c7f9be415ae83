import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, blob STRING, _words STRING, size BIGINT"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text,
    and extra columns whose names clash with those that operators use inside."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base), (2, base), (3, base.replace("word7", "other")), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long + " end"),
        (None, "a text without an id. It stands alone"), (None, base + " null"), (9, "one"), (10, "one two"), (10, "one two"), (11, "ONE"),
        (12, "token = abcdef123456 and AKIA" + "A1" * 10 + " 0123456789abcdef01234567"), (13, "Ünïcödé ßtraße 中文 тест. Ещё!"), (14, base.upper()), (15, "a  b\n\nc"), (16, "ab c"),
    ]
    return spark.createDataFrame([(d, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", "y", 7) for i, (d, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
