import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
A = " ".join(f"alpha{i} beta" for i in range(30))
B = " ".join(f"gamma{i}" for i in range(60))
#: Nulls in every column, empty, blank and very long texts, repeated rows and ids, copies, a shared passage.
ROWS = [
    (1, A, "en", "s1", 5),
    (2, A, "en", "s1", 5),
    (3, B + " " + A, "de", "s2", None),
    (4, None, None, None, None),
    (5, "", "en", "s1", 0),
    (6, " \t\n ", "en", "s1", 4),
    (7, LONG, "en", "s1", 9),
    (8, "one two", "fr", "s1", 7),
    (8, "one two", "fr", "s1", 7),
    (8, "Other text of the same id, licensed under the GNU General Public License, version 3.", "fr", "s1", 7),
    (None, B, "en", None, 3),
    (9, "É À ü ñ LICENSE MIT License — 你好 #*$%&|<>", None, "s1", 3),
    (10, "a b c d e a b c d e a b c d e f\nline\nline\n\n \nline", "en", "s1", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """The same rows with more columns, whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["w", "n", "h1", "h2", "h5", "t", "_key", "_row", "_part", "fp", "at", "k1", "k2", "own", "kept", "size", "shard", "words", "token", "label", "quality", "component", "n_removed", "_id", "_k_id", "_good"]
    return docs.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 1), (7, None, None), (None, 1, 0), (10, 1, None)], "doc_id long, quality int, toxic int")


def collected(df):
    """Rows as sorted tuples of text: order and row identity do not count."""
    return sorted(tuple(map(repr, r)) for r in df.collect())
