import pytest

SCHEMA = "doc_id long, text string, source string, rid long, score double, host string, spans string, rank int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, null ids, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 977} x{i % 31}" for i in range(20000))
    texts = [(1, "a b\tc\n d"), (2, "a b c d"), (3, None), (4, ""), (4, ""), (5, " "), (6, long), (7, long), (None, "a b c d"), (8, "é𝄞 ünï" * 9), (9, long + "."), (9, "other")]
    return spark.createDataFrame([(i, t, None if i == 2 else "s", 0, 0.0, "h", "x", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
