"""Registered SQL of the corpus queries against the queries, on the smallest tables."""

import duckdb
import pytest

from framewright.llm import queries
from framewright.llm.store import agreed


@pytest.mark.parametrize("name", ["op9_near_duplicates"])
def test_query_and_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.select(*columns).collect())


def test_labels_that_disagree_are_left_out(spark):
    labels = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (3, False)], "doc_id long, good boolean")
    assert {(r.doc_id, r.good) for r in agreed(labels, "good").collect()} == {(1, True), (3, False)}
