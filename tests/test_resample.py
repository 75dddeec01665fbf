"""Cubic derotation, template tables along paths, exact apertures: identities, closed forms and stamped cubes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import joins, resample
from framewright.sources import tables as src


def _dense_coefficients(v):
    """The B-spline through v with mirrored ends, by solving for all coefficients at once."""
    n = len(v)
    a = np.zeros((n, n))
    for i in range(n):
        for k, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            j = i + k
            a[i, j if 0 <= j < n else (-j if j < 0 else 2 * n - 2 - j)] += w
    return np.linalg.solve(a, v)


@pytest.mark.parametrize("n", [2, 3, 9, 40])
def test_recursive_filter_solves_the_spline(n):
    v = np.random.default_rng(n).normal(size=(3, n))
    assert resample.spline_coefficients(v) == pytest.approx(np.array([_dense_coefficients(r) for r in v]), abs=1e-10)


def test_cubic_polynomials_are_exact_inside():
    x, y = np.meshgrid(np.arange(60.0), np.arange(50.0), indexing="ij")
    f = lambda x, y: ((x - 30) ** 3 - 4 * (x - 30) * (y - 25) ** 2 + (y - 25) ** 3 + 7) / 1e3
    rng = np.random.default_rng(1)
    px, py = rng.uniform(22, 37, 200), rng.uniform(20, 29, 200)
    assert resample.spline_samples(f(x, y), px, py) == pytest.approx(f(px, py), abs=1e-9)
    frame = rng.normal(size=(12, 9))
    i, j = np.meshgrid(np.arange(12.0), np.arange(9.0), indexing="ij")
    assert resample.spline_samples(frame, i.ravel(), j.ravel()) == pytest.approx(frame.ravel(), abs=1e-12)
    assert resample.spline_samples(frame, np.array([-0.5, 11.5, 3.0]), np.array([2.0, 2.0, 8.5])).tolist() == [0, 0, 0]


def test_derotation(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3, 9, 9))
    cube = spark.createDataFrame([("d", f, x, y, float(v[f, x, y])) for f in range(3) for x in range(9) for y in range(9)], "dataset string, frame int, x int, y int, value double")
    frames = spark.createDataFrame([("d", 0, 0.0), ("d", 1, 90.0), ("d", 2, 180.0)], "dataset string, frame int, parang double")
    out = np.zeros_like(v)
    for r in resample.derotated_cubic(cube, frames, 9, 9).collect():
        out[r.frame, r.x, r.y] = r.value
    nearest = np.zeros_like(v)
    for r in joins.derotated(cube, frames, 9, 9, order=0).collect():
        nearest[r.frame, r.x, r.y] = r.value
    assert out[0] == pytest.approx(v[0], abs=1e-12) and out[2] == pytest.approx(v[2, ::-1, ::-1], abs=1e-9)
    assert out[1] == pytest.approx(nearest[1], abs=1e-9)  # a quarter turn takes cells to cells


def test_template_series_is_what_a_stamped_cube_has(spark):
    size, n = 25, 12
    frames = src.frames(spark.range(n).select(F.lit("d").alias("dataset"), F.col("id").cast("int").alias("frame")), field=50.0)
    rng = np.random.default_rng(3)
    cells = rng.uniform(0.1, 1, (9, 9))
    templates = spark.createDataFrame([("d", i, j, float(cells[i, j])) for i in range(9) for j in range(9)], "dataset string, x int, y int, value double")
    stamp = F.array(*[F.struct(F.lit(i).alias("tx"), F.lit(j).alias("ty"), F.lit(float(cells[i, j])).alias("tv")) for i in range(9) for j in range(9)])
    zero = frames.select("dataset", "frame").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("value", F.lit(0.0))
    parang = {r.frame: r.parang for r in frames.collect()}
    places = [(12, 17, 0), (8, 12, 5), (5, 9, 11), (16, 16, 3), (12, 12, 4), (14, 6, 7), (3, 12, 2), (19, 14, 9), (11, 20, 10), (9, 9, 6)]
    targets = spark.createDataFrame([("d", *p) for p in places], "dataset string, tx int, ty int, signal_time int")
    got = {(r.tx, r.ty, r.frame): r.expected for r in resample.template_series(targets, frames, templates, size, size, 9, 9).collect()}
    for tx, ty, time in places:
        dx, dy = tx - 12, ty - 12
        start = math.degrees(math.atan2(dy, dx)) - parang[time]
        at = frames.select("dataset", "frame", (F.lit(12.0) + math.hypot(dx, dy) * F.cos(F.radians(F.lit(start) + F.col("parang")))).alias("px"), (F.lit(12.0) + math.hypot(dx, dy) * F.sin(F.radians(F.lit(start) + F.col("parang")))).alias("py"), F.lit(1.0).alias("scale"))
        stack = {r.frame: r.value for r in joins._stamped(zero, at, stamp, 9).filter((F.col("x") == tx) & (F.col("y") == ty)).collect()}
        top = max(stack.values())
        for f in range(n):
            assert got[tx, ty, f] == pytest.approx(stack[f] / top, abs=1e-6)


@pytest.mark.parametrize("radius, cx, cy", [(0.3, 0.1, 0.2), (0.5, 0.0, 0.0), (1.0, 0.5, 0.5), (2.7, -0.31, 0.77), (6.0, 0.25, -0.4)])
def test_exact_areas(spark, radius, cx, cy):
    k = math.ceil(radius) + 2
    cells = spark.createDataFrame([(x, y) for x in range(-k, k + 1) for y in range(-k, k + 1)], "x int, y int")
    rows = cells.withColumn("a", resample.exact_overlap(F.col("x") - cx, F.col("y") - cy, radius)).collect()
    assert sum(r.a for r in rows) == pytest.approx(math.pi * radius**2, abs=1e-12 * max(1, radius**2) * 10)
    assert all(-1e-12 <= r.a <= 1 + 1e-12 for r in rows)
    u = (np.arange(400) + 0.5) / 400 - 0.5
    for r in rows:
        share = ((r.x - cx + u[:, None]) ** 2 + (r.y - cy + u[None]) ** 2 <= radius**2).mean()
        assert r.a == pytest.approx(share, abs=2e-3)
