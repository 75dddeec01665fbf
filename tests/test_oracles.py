"""Every query with an oracle against DuckDB, every other one for its rows; both on the smallest tables."""

import duckdb
import pytest

from framewright import queries

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(rows):
    value = lambda v: (round(v, 4) + 0.0) if isinstance(v, float) else v
    return sorted(tuple(value(v) for v in r) for r in rows) if not any(v is None for r in rows for v in r) else sorted((tuple(value(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = _plain(duck.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall())
    got = _plain([tuple(r) for r in df.select(*sorted(df.columns)).collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-4) if all(isinstance(v, (int, float)) for v in a) else str(a) == str(b) or a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
