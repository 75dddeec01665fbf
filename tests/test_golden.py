"""Analytic and golden cases: t-test, regressions, masks, binning, splines, PCA, injection, detection limits."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framewright.functions import coords as fx
from framewright.operators import evaluate as ev
from framewright.operators import joins, masks, models
from framewright.operators import series as ts
from framewright.sources import tables as src


def test_t_test(spark):
    df = spark.createDataFrame([(1, True, 5.0)] + [(1, False, float(v)) for v in (-1, 1, 0, -1, 1)], "g int, s boolean, value double")
    r = ev.with_fpf(ev.t_test(df, ["g"], F.col("s"))).first()
    assert (r.signal, r.noise) == (5.0, pytest.approx(math.sqrt(1.2)))
    assert (r.fpf, r.p_value) == (pytest.approx(0.0051523818), pytest.approx(0.9948476, abs=1e-7))


def test_t_tail_is_exact_far_out():
    assert ev.t_survival(np.array([0.0, 1.0, -1.0]), np.array([1.0, 1.0, 1.0])) == pytest.approx([0.5, 0.25, 0.75], abs=1e-12)
    df = 4.0  # closed form: 1/2 - 3/8 s (1 - s^2 / 12 ...) with the tail ~ 6 / t^4 for large t
    assert ev.t_survival(np.array([1e4]), np.array([df]))[0] == pytest.approx(6e-16, rel=1e-3)


def test_t_test_needs_samples(spark):
    df = spark.createDataFrame([(1, True, 5.0), (1, False, 1.0)], "g int, s boolean, value double")
    with pytest.raises(PySparkException):
        ev.t_test(df, ["g"], F.col("s")).collect()


def test_ols_with_signal():
    rng = np.random.default_rng(0)
    x, s = rng.normal(size=(101, 3)), np.exp(-np.linspace(-3, 3, 101) ** 2)
    x, y = (x - x.mean(0)) / x.std(0), None
    y = x @ np.array([1.0, 2.0, 3.0]) + 1.5 * s
    f = models.fit_series(x, y, 1, "LinearRegression", expected=s, mode="signal_fitting")
    assert f["signal"] == pytest.approx(1.5)
    assert f["residual"] - f["residual"].mean() == pytest.approx(1.5 * (s - s.mean()), abs=1e-8)
    y = x @ np.array([1.0, 2.0, 3.0]) - s
    f = models.fit_series(x, y, 1, "LinearRegression", expected=s, mode="signal_fitting")
    assert f["signal"] == pytest.approx(-1.0)  # refitted without the signal
    plain = models.fit_series(x, y, 1, "LinearRegression")
    assert f["residual"] == pytest.approx(plain["residual"], abs=1e-9)


def test_masking_needs_a_third():
    x, y, s = np.random.default_rng(1).normal(size=(101, 2)), np.zeros(101), np.where(np.arange(101) < 70, 0.9, 0.0)
    assert np.isnan(models.fit_series(x, y, 1, "LinearRegression", expected=s, mode="signal_masking")["residual"]).all()
    s = np.where(np.arange(101) < 50, 0.9, 0.0)
    assert np.isfinite(models.fit_series(x, y, 1, "LinearRegression", expected=s, mode="signal_masking")["residual"]).all()


def test_leave_one_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    y = x @ rng.normal(size=5) + rng.normal(size=30)
    x, y, alphas = x - x.mean(0), y - y.mean(), np.geomspace(0.1, 100, 7)

    def error(a):
        out = []
        for i in range(30):
            k = np.arange(30) != i
            mx, my = x[k].mean(0), y[k].mean()
            c = np.linalg.solve((x[k] - mx).T @ (x[k] - mx) + a * np.eye(5), (x[k] - mx).T @ (y[k] - my))
            out.append((y[i] - my - (x[i] - mx) @ c) ** 2)
        return np.mean(out)

    assert models.best_penalty(x, y, alphas) == pytest.approx(alphas[int(np.argmin([error(a) for a in alphas]))])


def test_mirror_cube_is_predicted(spark):
    rng = np.random.default_rng(3)
    half = rng.normal(size=(20, 7, 7))
    cube = half + half[:, ::-1, ::-1]
    s = spark.createDataFrame([(x, y, cube[:, x, y].tolist()) for x in range(7) for y in range(7)], "x int, y int, v array<double>")
    pairs = s.select(F.col("x").alias("tx"), F.col("y").alias("ty"), (6 - F.col("x")).alias("x"), (6 - F.col("y")).alias("y"))
    for r in models.fit_pixels(pairs, s, folds=2, model="LinearRegression").collect():
        assert np.abs(r.residual).max() < 1e-9 and r.coefficients == pytest.approx([1.0])


def test_binning(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate((1, 3, 5, 7, 9))], "frame int, value double")
    assert sorted(r.value for r in ts.binned(df, 2, [], how=F.median).collect()) == [2, 6, 9]
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(6)], "frame int, value double")
    assert sorted(r.value for r in ts.binned(df, 3, []).collect()) == [2, 5]


@pytest.mark.parametrize("k, want", [(3, [0, 4, 9]), (2, [0, 9]), (1, [0]), (0, [])])
def test_signal_times(spark, k, want):
    df = spark.createDataFrame([("a", i) for i in range(10)], "dataset string, frame int")
    assert sorted(r.signal_time for r in ts.signal_times(df, k).collect()) == want


def test_field_rotation(spark):
    rows = [("a", i, v) for i, v in enumerate((-240.4, -249.3, -261.2, 88.2, 76.5, 64.7, 55.7))]
    df = spark.createDataFrame(rows, "dataset string, frame int, parang double")
    assert ts.field_rotation(df).first().rotation == pytest.approx(63.9)
    df = spark.createDataFrame([("a", i, 10 + i * 240 / 9) for i in range(10)], "dataset string, frame int, parang double")
    with pytest.raises(PySparkException):
        ts.field_rotation(df).collect()


def test_detection_limit(spark):
    threshold = -math.log10(math.erfc(5 / math.sqrt(2)) / 2)
    rows = [(3.0, float(c), 10 ** -(threshold + math.tanh((15 - c) / 2) - 0.5)) for c in range(5, 16)]
    df = spark.createDataFrame(rows, "separation double, expected_contrast double, fpf_median double")
    assert ev.detection_limits(df).first().limit == pytest.approx(15 - 2 * math.atanh(0.5), abs=0.05)


def test_cosine_of_zero_and_pearson_of_constant(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "a double, b double")
    r = df.agg(ts.cosine(F.col("a"), F.col("b")).alias("c"), ts.pearson(F.col("a"), F.col("b")).alias("p")).first()
    assert (r.c, r.p) == (0.0, None)


def test_nearest_takes_the_lower(spark):
    v = spark.createDataFrame([("a", 1.5), ("a", 0.0), ("a", 9.0), ("a", 2.6)], "k string, v double")
    g = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "k string, g double")
    assert {r.v: r.g for r in joins.nearest(v, g, "v", "g", ["k"]).collect()} == {1.5: 1.0, 0.0: 1.0, 9.0: 3.0, 2.6: 3.0}


def test_spline(spark):
    t = np.sort(np.random.default_rng(4).uniform(0, 50, 400))
    y = np.sin(t / 5) * 5
    i = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(t, y)], "parameter string, t double, integral double")
    q = spark.createDataFrame([("p", float(v)) for v in np.linspace(2, 48, 60)], "parameter string, t double")
    for r in models.interpolated(i, q, chunk_seconds=10).collect():
        assert r.value == pytest.approx(math.cos(r.t / 5), abs=2e-3)
    cubic = t**3 - 20 * t**2
    assert models.spline_slopes(t, cubic) == pytest.approx(3 * t**2 - 40 * t, rel=1e-6, abs=1e-5)


def test_injection_comes_back_out(spark):
    cube = spark.createDataFrame([("d", f, x, y, 0.0) for f in range(6) for x in range(21) for y in range(21)], "dataset string, frame int, x int, y int, value double")
    frames = src.frames(cube, field=60.0)
    stamp = src.gaussian_template(9, 1.2)
    out, at = joins.injected(cube, frames, stamp, 9, 5.0, 45.0, 0.0, 21, 21)
    assert at.count() == 6
    back, _ = joins.injected(out, frames, stamp, 9, 5.0, 45.0, 0.0, 21, 21, extra=-1.0)
    assert back.agg(F.max(F.abs("value"))).first()[0] < 1e-12
    turned = joins.derotated(out, frames, 21, 21).groupBy("x", "y").agg(F.avg("value").alias("value"))
    peak = turned.orderBy(F.desc("value")).first()
    px, py = 10 + 5 * math.cos(math.radians(135)), 10 + 5 * math.sin(math.radians(135))
    assert math.hypot(peak.x - px, peak.y - py) < 1.0 and peak.value > 0.6


def test_pca_matches_svd(spark):
    v = np.random.default_rng(5).normal(size=(8, 4, 5))
    cube = spark.createDataFrame([(f, x, y, float(v[f, x, y])) for f in range(8) for x in range(4) for y in range(5)], "frame int, x int, y int, value double")
    got, _ = models.pca_residuals(cube, [1, 3])
    m = v.reshape(8, -1)
    m = m - m.mean(0)
    u, s, w = np.linalg.svd(m, full_matrices=False)
    for r in got.collect():
        want = m - (u[:, : r.n] * s[: r.n]) @ w[: r.n]
        assert r.value == pytest.approx(want[r.frame, r.x * 5 + r.y], abs=1e-9)


def test_pca_beyond_the_exact_product(spark):
    rng = np.random.default_rng(6)
    strong = rng.normal(size=(700, 3)) @ (np.array([[30.0], [20.0], [10.0]]) * rng.normal(size=(3, 30)))
    v = strong + 0.1 * rng.normal(size=(700, 30))
    v[5, 7] = np.nan
    cube = spark.createDataFrame([(f, p // 5, p % 5, None if np.isnan(v[f, p]) else float(v[f, p])) for f in range(700) for p in range(30)], "frame int, x int, y int, value double")
    got, scores = models.pca_residuals(cube, [2, 3])
    m = np.nan_to_num(v)
    m = m - m.mean(0)
    u, s, w = np.linalg.svd(m, full_matrices=False)
    assert scores.count() == 3 * 700
    left = {n: np.zeros_like(m) for n in (2, 3)}
    for r in got.collect():
        left[r.n][r.frame, r.x * 5 + r.y] = r.value
    for n in (2, 3):
        assert left[n] == pytest.approx(m - (u[:, :n] * s[:n]) @ w[:n], abs=1e-6)


def test_gaussian_fit(spark):
    rows = [(0, x, y, 3.0 * math.exp(-((x - 10.3) ** 2 + (y - 9.6) ** 2) / (2 * 1.7**2))) for x in range(21) for y in range(21)]
    maps = spark.createDataFrame(rows, "map_id int, x int, y int, value double")
    pos = spark.createDataFrame([(0, 0, 10.0, 10.0)], "map_id int, target int, px double, py double")
    r = ev.gaussian_fluxes(maps, pos, radius=8.0, search=1.0).first()
    assert (r.amplitude, r.sigma, r.px, r.py) == (pytest.approx(3.0), pytest.approx(1.7), pytest.approx(10.3), pytest.approx(9.6))


def test_contrasts(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0, 3.0), (0.05, 0.0, 5.0, 5.0)], "raw_flux double, background_flux double, stellar_flux double, expected_contrast double")
    a, b = ev.contrasts(df).collect()
    assert (a.observed_contrast, a.throughput) == (math.inf, 0.0)
    assert (b.observed_contrast, b.throughput) == (pytest.approx(5.0), pytest.approx(1.0))


def test_components(spark):
    cells = [(0, 0), (0, 1), (1, 1), (5, 5), (6, 6), (6, 7), (7, 7), (7, 8)]
    mask = spark.createDataFrame([(1, x, y) for x, y in cells], "map_id int, x int, y int")
    kept = masks.without_components(mask, src.checkpointed, least=2, most=3)
    assert {(r.x, r.y) for r in kept.collect()} == {(0, 0), (0, 1), (1, 1)}


def test_covariate_selection(spark):
    df = spark.createDataFrame([("d", 0, "a", 1.0), ("d", 0, "b", 2.0)], "dataset string, frame int, key string, value double")
    assert ts.selected(df, None).count() == 0 and ts.selected(df, "all").count() == 2
    with pytest.raises(KeyError):
        ts.selected(df, ["c"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, 2.5)], "dataset string, frame int, value double")
    src.write_results(df, f"{tmp_path}/a", partition_by=("dataset",))
    assert src.read_results(spark, f"{tmp_path}/a").first().value == 2.5
    with pytest.raises(PySparkException):
        src.write_results(df, f"{tmp_path}/a", overwrite=False)
    src.write_tsv(df, f"{tmp_path}/b")
    assert src.read_tsv(spark, f"{tmp_path}/b", df.schema).collect() == df.collect()


def test_template_and_labels_are_checked(spark):
    psf = spark.createDataFrame([("d", 0, 0, 1.0), ("d", 0, 0, 2.0)], "dataset string, x int, y int, value double")
    with pytest.raises(PySparkException):
        src.one_template(psf).collect()
    assert spark.range(1).select(fx.injection_angle(F.lit("b"))).first()[0] == 330
    with pytest.raises(PySparkException):
        spark.range(1).select(fx.injection_angle(F.lit("z"))).collect()


def test_missing_target_values_are_left_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, 2.0] + 0.5
    y[[4, 17]] = np.nan
    f = models.fit_series(x, y, 3, "LinearRegression")
    assert np.isnan(f["residual"][[4, 17]]).all()
    assert np.abs(np.delete(f["residual"], [4, 17])).max() < 1e-9
    assert np.isnan(models.fit_series(x, np.full(60, np.nan), 3, "LinearRegression")["residual"]).all()


def test_components_send_nothing_through_the_driver(spark):
    """Labels spread by sort and merge: small files of labels hold many rows, and a broadcast takes them all to the driver in every round."""
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return src.checkpointed(df)

    mask = spark.createDataFrame([(0, x, y) for x, y in [(0, 0), (0, 1), (0, 2), (5, 5), (5, 6), (9, 9)]], "map_id int, x int, y int")
    kept = masks.without_components(mask, written, least=2)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert {(r.x, r.y) for r in kept.collect()} == {(0, 0), (0, 1), (0, 2), (5, 5), (5, 6)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_pixels_are_fitted_by_squares_of_targets(spark):
    """The same fits as one by one, also with missing values, in one group per square of targets."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(11, 9, 12))
    v[2, 3, 4] = v[10, 8, 0] = np.nan
    s = spark.createDataFrame([(x, y, [None if np.isnan(z) else float(z) for z in v[x, y]]) for x in range(11) for y in range(9)], "x int, y int, v array<double>")
    pairs = spark.createDataFrame([(x, y, 10 - x, 8 - y) for x in range(11) for y in range(9)] + [(0, 0, 3, 3)], "tx int, ty int, x int, y int")
    e = np.exp(-((np.arange(12) - 5.0) ** 2) / 4)
    expected = spark.createDataFrame([(1, 1, k, e.tolist()) for k in (5, 2)], "tx int, ty int, signal_time int, e array<double>")
    out = models.fit_pixels(pairs, s, expected, folds=2, model="LinearRegression", mode="signal_fitting")
    got = {(r.tx, r.ty, r.signal_time): r for r in out.collect()}
    assert len(got) == 11 * 9 + 1 and {(1, 1, 2), (1, 1, 5)} <= set(got)
    for (x, y, time), r in got.items():
        p = v[[3, 10], [3, 8]].T if (x, y) == (0, 0) else v[10 - x, 8 - y][:, None]
        p = np.where(np.isnan(p), np.nanmean(p, axis=0), p)
        want = models.fit_series(p, v[x, y], 2, "LinearRegression", (1.0,), None if time is None else e, "signal_fitting")
        assert np.array(r.residual, float) == pytest.approx(want["residual"], abs=1e-12, nan_ok=True)
        assert r.coefficients == pytest.approx(want["coefficients"].mean(0), abs=1e-12) and (r.signal is None) == (time is None)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroups" in plan and "ti#" in plan.split("FlatMapGroups")[1].split("\n")[0]


def test_correlation_map_sends_a_series_to_few_blocks(spark, monkeypatch):
    """Blocks grow with the pixels, so that copies of series stay few; products come strip by strip."""
    v = np.random.default_rng(8).normal(size=(70, 9))
    v[5] = 2.0
    s = spark.createDataFrame([(k // 8, k % 8, v[k].tolist()) for k in range(70)], "x int, y int, v array<double>")
    monkeypatch.setattr(ts, "_PAIRS", 11)
    got = {(r.x * 8 + r.y, r.x2 * 8 + r.y2): r.value for r in ts.correlation_map(s).collect()}
    assert set(got) == {(a, b) for a in range(70) for b in range(a, 70)}
    d = v - v.mean(1, keepdims=True)
    want = d @ d.T / (np.sqrt(np.outer((d**2).sum(1), (d**2).sum(1))) + 2.220446049250313e-16)
    assert all(value == pytest.approx(want[k], abs=1e-12) for k, value in got.items())
    many = spark.range(20000).selectExpr("cast(id % 25 as int) x", "cast(id / 25 as int) y", "array(1.0D, 2.0D) v")
    plan = ts.correlation_map(many)._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 15" in plan


def test_correlation_map_is_small_as_parquet(spark, monkeypatch, tmp_path):
    """Pixels come in runs and values keep a dictionary in the files; no pair is lost or doubled, also of missing values."""
    monkeypatch.setattr(ts, "_BLOCKS", 2)
    v = np.random.default_rng(4).normal(size=(1200, 64))
    s = spark.createDataFrame([(k % 25, k // 25, v[k].tolist()) for k in range(1200)], "x int, y int, v array<double>")
    ts.correlation_map(s).withColumn("value", F.round("value", 5)).write.parquet(f"{tmp_path}/map")
    files = [pq.ParquetFile(f) for f in sorted(tmp_path.glob("map/*.parquet"))]
    columns = [f.metadata.row_group(g).column(4) for f in files for g in range(f.metadata.num_row_groups)]
    assert columns and all("PLAIN" not in c.encodings for c in columns)
    assert sum(f.metadata.row_group(g).column(k).total_compressed_size for f in files for g in range(f.metadata.num_row_groups) for k in range(5)) < 6 * 1200 * 1201 / 2
    t = pa.concat_tables([f.read() for f in files])
    x, y, x2, y2, value = (t[c].to_numpy() for c in ("x", "y", "x2", "y2", "value"))
    a, b = y * 25 + x, y2 * 25 + x2
    assert np.all((x < x2) | ((x == x2) & (y <= y2))) and len(np.unique(a * 1200 + b)) == len(a) == 1200 * 1201 // 2
    d = v - v.mean(1, keepdims=True)
    assert np.abs(value - (d @ d.T / np.sqrt(np.outer((d**2).sum(1), (d**2).sum(1))))[a, b]).max() < 0.6e-5
    v[7, 3] = np.nan
    s = spark.createDataFrame([(k % 25, k // 25, v[k].tolist()) for k in range(60)], "x int, y int, v array<double>")
    got = ts.correlation_map(s).collect()
    assert len(got) == 60 * 61 // 2 and sum(np.isnan(r.value) for r in got) == 60
