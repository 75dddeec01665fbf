"""Fits by tile: against plain least squares with the columns appended, against fits by pixel, gates, masks, missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import models, tiles

N, SIZE = 60, 11
MASK = tiles.PredictorMask(SIZE, SIZE, 2.5, 1.5, 1.2)


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(8).normal(size=(N, SIZE, SIZE))


def _series(spark, cube):
    rows = [("d", x, y, [None if np.isnan(v) else float(v) for v in cube[:, x, y]]) for x in range(SIZE) for y in range(SIZE)]
    return spark.createDataFrame(rows, "dataset string, x int, y int, v array<double>")


def _targets(spark, places):
    return spark.createDataFrame([("d", *p) for p in places], "dataset string, tx int, ty int")


def _covariates(spark, c):
    return spark.createDataFrame([("d", f, f"k{k}", float(c[f, k])) for f in range(N) for k in range(c.shape[1])], "dataset string, frame int, key string, value double")


def _plain(x, y, train, apply):
    """Prediction of the rows ``apply`` by least squares of y on 1 and x."""
    a = np.column_stack([np.ones(len(x)), x])
    return a[apply] @ np.linalg.lstsq(a[train], y[train], rcond=None)[0]


def test_bordered_is_least_squares_with_the_columns_appended():
    rng = np.random.default_rng(0)
    for n, p, q in ((30, 5, 3), (12, 20, 2)):
        a, b, y = rng.normal(size=(n, p)), rng.normal(size=(n, q)), rng.normal(size=n)
        f = tiles.factored(a, a.T @ a)
        for penalty in (0.0, 0.7) if n > p else (0.7,):
            x = np.column_stack([a, b])
            m = np.linalg.inv(x.T @ x + penalty * np.eye(p + q))
            ca, cb, r, h = tiles.bordered(f, b, y, penalty)
            assert np.concatenate([ca, cb]) == pytest.approx(m @ x.T @ y)
            assert r == pytest.approx(y - x @ m @ x.T @ y) and h == pytest.approx(np.diag(x @ m @ x.T))


@pytest.mark.parametrize("folds", [1, 3])
def test_covariates_are_predictors(spark, cube, folds):
    c = np.random.default_rng(1).normal(size=(N, 3))
    places = [(5, 5), (2, 7), (0, 0), (10, 3), (7, 8)]
    out = tiles.fit_tiles(_series(spark, cube), _targets(spark, places), MASK, covariates=_covariates(spark, c), folds=folds, model="LinearRegression", width=4).collect()
    assert len(out) == len(places)
    for r in out:
        x = np.column_stack([cube[:, a, b] for a, b in zip(r.px, r.py)] + [c])
        y, fold = cube[:, r.tx, r.ty], np.arange(N) % folds
        want = np.concatenate([y[fold == k] - _plain(x, y, fold != k if folds > 1 else fold == k, fold == k) for k in range(folds)])
        assert np.concatenate([np.array(r.residual)[fold == k] for k in range(folds)]) == pytest.approx(want, abs=1e-9)
        assert r.keys == ["k0", "k1", "k2"] and {(a, b) for a, b in zip(r.px, r.py)} == {(a, b) for a in range(SIZE) for b in range(SIZE) if MASK.of(np.array(a), np.array(b), r.tx, r.ty)}


def test_same_as_fits_by_pixel(spark, cube):
    cube = cube.copy()
    cube[3, 5, 5] = np.nan  # of a target
    cube[7, 4, 5] = np.nan  # of a predictor
    s, targets = _series(spark, cube), _targets(spark, [(5, 5), (6, 2), (9, 9)])
    e = np.exp(-((np.arange(N) - 20) ** 2) / 30)
    expected = targets.select("dataset", "tx", "ty", F.explode(F.array(F.lit(10), F.lit(20))).alias("signal_time")).withColumn("e", F.array(*[F.lit(float(v)) for v in e]))
    pairs = s.select("x", "y").crossJoin(targets.select("tx", "ty"))
    near = lambda r, x, y: F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2) < r * r
    pairs = pairs.filter((near(2.5, F.col("tx"), F.col("ty")) | near(1.5, 10 - F.col("tx"), 10 - F.col("ty"))) & ~near(1.2, F.col("tx"), F.col("ty")))
    for mode, model in (("signal_fitting", "RidgeCV"), ("signal_masking", "Ridge")):
        alphas = [0.5, 5.0, 50.0]
        got = {(r.tx, r.ty, r.signal_time): r for r in tiles.fit_tiles(s, targets, MASK, expected, folds=3, model=model, alphas=alphas, mode=mode, width=4).collect()}
        assert len(got) == 9
        for e_of in (expected, None):
            for r in models.fit_pixels(pairs, s, e_of, 3, model, alphas, mode if e_of is not None else "default").collect():
                g = got[r.tx, r.ty, r.signal_time if e_of is not None else None]
                want = [np.nan if v is None else v for v in r.residual]
                assert [np.nan if v is None else v for v in g.residual] == pytest.approx(want, abs=1e-8, nan_ok=True)
                assert g.coefficients == pytest.approx(r.coefficients, abs=1e-8) and g.penalty == pytest.approx(r.penalty)
                assert e_of is None or mode == "signal_masking" or g.signal == pytest.approx(r.signal)


def test_gate_by_signal_time(spark, cube):
    e = np.exp(-((np.arange(N) - 20) ** 2) / 30)
    c = np.column_stack([e + 0.01 * cube[:, 0, 0], np.random.default_rng(2).normal(size=N), np.ones(N)])
    expected = spark.createDataFrame([("d", 5, 5, 20, e.tolist()), ("d", 5, 5, 30, [0.5] * N)], "dataset string, tx int, ty int, signal_time int, e array<double>")
    out = tiles.fit_tiles(_series(spark, cube), _targets(spark, [(5, 5)]), MASK, expected, _covariates(spark, c), folds=2, model="LinearRegression", mode="signal_fitting")
    assert {r.signal_time: r.keys for r in out.collect()} == {None: ["k0", "k1", "k2"], 20: ["k1"], 30: ["k0", "k1", "k2"]}
    assert tiles.admissible(e, np.column_stack([e, -e, np.r_[e[20:], e[:20]]]), 0.5).tolist() == [False, False, True]


def test_masking_refused_and_mirror_cube(spark):
    half = np.random.default_rng(3).normal(size=(N, SIZE, SIZE))
    cube = half + half[:, ::-1, ::-1]
    flags = [0.9] * 45 + [0.0] * 15
    expected = spark.createDataFrame([("d", 2, 3, 5, flags)], "dataset string, tx int, ty int, signal_time int, e array<double>")
    mirror = tiles.PredictorMask(SIZE, SIZE, 0.5, 0.5, 0.6)
    out = {(r.tx, r.ty, r.signal_time): r for r in tiles.fit_tiles(_series(spark, cube), _targets(spark, [(2, 3), (8, 1)]), mirror, expected, folds=2, model="LinearRegression", mode="signal_masking").collect()}
    assert set(out) == {(2, 3, None), (8, 1, None), (2, 3, 5)} and out[2, 3, 5].residual is None
    for key in ((2, 3, None), (8, 1, None)):
        assert np.abs(out[key].residual).max() < 1e-9 and out[key].coefficients == pytest.approx([1.0])


def test_halo_reaches_every_tile_that_needs_a_pixel(spark):
    pixels = spark.createDataFrame([(x, y) for x in range(SIZE) for y in range(SIZE)], "x int, y int")
    have = {(r.x, r.y, r.ti, r.tj) for r in tiles.halo(pixels, MASK, 4).collect()}
    x, y = np.meshgrid(np.arange(SIZE), np.arange(SIZE), indexing="ij")
    for tx in range(SIZE):
        for ty in range(SIZE):
            m = MASK.of(x, y, tx, ty)
            m[tx, ty] = True
            assert all((a, b, tx // 4, ty // 4) in have for a, b in np.argwhere(m).tolist())
