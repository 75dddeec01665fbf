"""Tiled scans against windows and solves over whole keys."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import models, scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(p, float(t), float(v)) for p, n in (("a", 300), ("b", 7), ("c", 1)) for t, v in zip(np.sort(rng.uniform(-40, 90, n)), rng.normal(size=n))], "parameter string, t double, value double")


def test_numbers(rows):
    got = scans.numbered(rows, ["parameter"], ["t"], F.floor(F.col("t") / 5))
    want = rows.withColumn("number", F.row_number().over(Window.partitionBy("parameter").orderBy("t")) - 1)
    key = lambda df: sorted((r.parameter, r.t, r.number) for r in df.collect())
    assert key(got) == key(want) and {(r.parameter, r._n) for r in got.collect()} == {("a", 300), ("b", 7), ("c", 1)}


def test_areas(rows):
    got = {(r.parameter, r.t): r.integral for r in scans.running_areas(rows, "parameter", "t", "value", 5.0).collect()}
    for p in "abc":
        own = sorted((r.t, r.value) for r in rows.collect() if r.parameter == p)
        total = 0.0
        for k, (t, _) in enumerate(own):
            total += own[k - 1][1] * (t - own[k - 1][0]) if k else 0.0
            assert got[p, t] == pytest.approx(total, abs=1e-9)


def test_brackets(spark, rows):
    points = spark.createDataFrame([("a", float(t), k) for k, t in enumerate((-90, -3, 0, 0.5, 60, 61, 200))] + [("b", 10.0, 9)], "parameter string, p double, k int")
    got = scans.bracketed(rows, points, "t", "p", ["parameter"], 7.0).collect()
    assert len(got) == rows.count()
    have = {"a": (-90, -3, 0, 0.5, 60, 61, 200), "b": (10.0,), "c": ()}
    for r in got:
        below, above = [p for p in have[r.parameter] if p <= r.t], [p for p in have[r.parameter] if p >= r.t]
        assert (r.below and r.below["at"]) == (max(below) if below else None) and (r.above and r.above["at"]) == (min(above) if above else None)


@pytest.mark.parametrize("size", [4, 7, 50, 1000])
def test_spline_of_all_tiles_is_one_spline(spark, size):
    rng = np.random.default_rng(size)
    knots = {p: (np.sort(rng.uniform(0, 30 * 86400, n)), rng.normal(size=n)) for p, n in (("a", 400), ("b", 9), ("c", 4), ("d", 2), ("e", 1))}
    df = spark.createDataFrame([(p, float(t), float(y)) for p, (ts, ys) in knots.items() for t, y in zip(ts, ys)], "parameter string, t double, y double")
    got = {(r.parameter, r.t): r.slope for r in scans.spline_slopes(df, size=size).collect()}
    for p, (t, y) in knots.items():
        want = models.spline_slopes(t - t[0], y - y[0])
        assert [got[p, float(x)] for x in t] == pytest.approx(want, rel=1e-9, abs=1e-9 * max(1e-12, np.abs(want).max()))


def test_derivatives(spark):
    t = np.sort(np.random.default_rng(4).uniform(0, 50, 400))
    df = spark.createDataFrame([("p", float(a), float(a**3 - 20 * a**2)) for a in t], "parameter string, t double, y double")
    times = spark.createDataFrame([("p", float(v)) for v in [-1.0, t[0], t[7], 12.5, 30.0, 49.0, t[-1], 51.0]], "parameter string, t double")
    for r in scans.spline_derivatives(df, times, 10.0, 16).collect():
        inside = t[0] <= r.t <= t[-1]
        assert r.value == (pytest.approx(3 * r.t**2 - 40 * r.t, rel=1e-6, abs=1e-5) if inside else None)


def test_brackets_go_through_a_tile_once(rows):
    """A frame up to the end of its window is gone through anew for every row: quadratic in the rows of a tile."""
    got = scans.bracketed(rows, rows.select("parameter", F.col("t").alias("p")), "t", "p", ["parameter"], 1e6)
    assert "unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()
    assert all(r.below["at"] == r.t == r.above["at"] for r in got.collect())
