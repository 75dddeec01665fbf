import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and clashing column names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(120_000))
    body = "The river runs past the old mill and the children count the boats that pass by in the evening light before supper is called."
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t\n", None, "b", 3), (4, long, "en", "b", len(long)), (5, body, "en", None, 9),
        (5, body, "en", None, 9), (6, body, "de", "a", 9), (None, body, "en", "a", 9), (None, "only here, a text without a name that nobody else wrote down", "fr", None, None),
        (7, "x", "en", "a", 1), (8, "é\nü\n\n" + body, "fr", "a", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "node", "_node", "key_0", "node_0", "spans", "numbers", "v", "root", "size", "taken"):
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
