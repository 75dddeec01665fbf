"""Leave-fold-out regressions per pixel, PCA subtraction, clustering, covariate interpolation.

A target pixel goes with the series of its predictors, whose number the mask radii bound; a group is a small square of targets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.scans import spline_derivatives
from framewright.operators.series import first_peak


def least_squares(x: np.ndarray, y: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Coefficients for centred x and y; ``penalty`` shrinks them."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    keep = s > s.max(initial=0) * max(x.shape) * np.finfo(float).eps
    u, s, vt = u[:, keep], s[keep], vt[keep]
    return vt.T @ (s / (s**2 + penalty) * (u.T @ y))


def best_penalty(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> float:
    """The penalty of the least mean squared leave-one-out residual r / (1 - h)."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    uy, n = u.T @ y, len(y)
    errors = []
    for a in alphas:
        shrink = s**2 / (s**2 + a)
        leverage = (u**2 * shrink).sum(1) + 1 / n
        errors.append(np.mean(((y - u @ (shrink * uy)) / np.maximum(1 - leverage, 1e-12)) ** 2))
    return float(alphas[int(np.argmin(errors))])


#: name -> (x, y, alphas) -> coefficients and the penalty used
BASE_MODELS: dict[str, Callable] = {
    "LinearRegression": lambda x, y, alphas: (least_squares(x, y), 0.0),
    "Ridge": lambda x, y, alphas: (least_squares(x, y, float(alphas[0])), float(alphas[0])),
    "RidgeCV": lambda x, y, alphas: (lambda a: (least_squares(x, y, a), a))(best_penalty(x, y, np.asarray(alphas))),
}


def fit_series(x: np.ndarray, y: np.ndarray, folds: int, model: str = "RidgeCV", alphas=(1.0,), expected: np.ndarray | None = None, mode: str = "default") -> dict:
    """Residual of y under predictions from x, each fold predicted by a fit on the others.

    ``signal_fitting`` fits the expected signal along and drops it from the prediction (a negative share means a refit
    without it); ``signal_masking`` fits where the signal is below 0.2, if a third of the rows is left. Rows without a y are neither
    fitted nor predicted.
    """
    n = len(y)
    residual, signal, penalties = np.full(n, np.nan), [], []
    coefficients = np.zeros((folds, x.shape[1]))
    fold = np.arange(n) % folds
    solve = BASE_MODELS[model]
    for k in range(folds):
        apply = fold == k
        train = (~apply if folds > 1 else apply) & np.isfinite(y)
        if train.sum() < 2:
            continue
        if mode == "signal_masking" and expected is not None:
            calm = train & ~(expected >= 0.2)
            if calm.sum() < 0.33 * train.sum():
                return {"residual": np.full(n, np.nan), "coefficients": np.full((folds, x.shape[1]), np.nan), "signal": np.nan, "penalty": np.nan}
            train = calm
        mx, sx = x[train].mean(0), x[train].std(0)
        my, sy = y[train].mean(), y[train].std() or 1.0
        sx = np.where(sx == 0, 1, sx)
        a, b = (x[train] - mx) / sx, (y[train] - my) / sy
        share = np.nan
        if mode == "signal_fitting" and expected is not None:
            e = expected[train] * 1000
            ma, me = a.mean(0), e.mean()
            c, alpha = solve(np.column_stack([a - ma, e - me]), b - b.mean(), alphas)
            share, c = c[-1] * 1000 * sy, c[:-1]
            if share < 0:
                c, alpha = solve(a, b, alphas)
                base = 0.0
            else:
                base = -c @ ma - (share / sy / 1000) * me
        else:
            c, alpha = solve(a, b, alphas)
            base = 0.0
        residual[apply] = y[apply] - (((x[apply] - mx) / sx) @ c + base) * sy - my
        coefficients[k] = c
        signal.append(share)
        penalties.append(alpha)
    return {"residual": residual, "coefficients": coefficients, "signal": float(np.mean(signal)) if signal else np.nan, "penalty": float(np.mean(penalties)) if signal else np.nan}


_TYPES = {"int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
FIT_SCHEMA = "tx int, ty int, signal_time int, residual array<double>, px array<int>, py array<int>, coefficients array<double>, signal double, penalty double"
FIT_TYPES = {c.split()[0]: _TYPES[c.split()[1]] for c in FIT_SCHEMA.split(", ")}
_TILE = 8  # targets a side of a group


def fit_pixels(pairs: DataFrame, series: DataFrame, expected: DataFrame | None = None, folds: int = 3, model: str = "RidgeCV", alphas=(1.0,), mode: str = "default") -> DataFrame:
    """One row per target and signal time: residual series, mean coefficient of each predictor, signal share, penalty.

    ``pairs`` (tx, ty, x, y); ``series`` (x, y, v); ``expected`` (tx, ty, signal_time, e) as series. All signal times of a target
    are fitted together, so its predictors move once. A group is a square of _TILE targets a side: the cost of a group is not paid for each target.
    """
    met = pairs.select("tx", "ty", "x", "y").join(series.select("x", "y", "v"), ["x", "y"])
    own = series.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("x"), F.col("y"), "v")
    targets = met.select("tx", "ty").distinct()
    rows = met.withColumn("kind", F.lit(0)).unionByName(own.join(targets, ["tx", "ty"], "left_semi").withColumn("kind", F.lit(1)))
    rows = rows.withColumn("signal_time", F.lit(None).cast("int"))
    if expected is not None:
        e = expected.select("tx", "ty", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("e").alias("v"), F.lit(2).alias("kind"), "signal_time")
        rows = rows.unionByName(e.join(targets, ["tx", "ty"], "left_semi").select(*rows.columns))

    def matrix(v: pa.ChunkedArray) -> np.ndarray:
        """One row per series, NaN where a value is missing."""
        v = v.combine_chunks()
        return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) if len(v) else np.zeros((0, 0))

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([(c, "ascending") for c in ("tx", "ty", "kind", "x", "y", "signal_time")])
        tx, ty, kind, px, py = (tile[c].to_numpy() for c in ("tx", "ty", "kind", "x", "y"))
        times = tile["signal_time"].to_pylist()
        out = []
        starts = np.flatnonzero(np.append(True, (np.diff(tx) != 0) | (np.diff(ty) != 0)))
        for lo, hi in zip(starts, np.append(starts[1:], len(tx))):
            own, signal = lo + np.searchsorted(kind[lo:hi], [1, 2])
            if own == lo or own == signal:
                continue
            x = matrix(tile["v"].slice(lo, own - lo)).T
            if np.isnan(x).any():
                x = np.where(np.isnan(x), np.nan_to_num(pd.DataFrame(x).mean().to_numpy()), x)
            y = matrix(tile["v"].slice(own, 1))[0]
            for at in range(signal, hi) if signal < hi else [None]:
                e = None if at is None else np.nan_to_num(matrix(tile["v"].slice(at, 1))[0])
                f = fit_series(x, y, folds, model, alphas, e, mode)
                out.append((tx[lo], ty[lo], None if at is None else times[at], f["residual"], px[lo:own], py[lo:own], f["coefficients"].mean(0), f["signal"], f["penalty"]))
        columns = list(zip(*out)) or [()] * len(FIT_TYPES)
        return pa.table({name: pa.array(column, kind, from_pandas=True) for (name, kind), column in zip(FIT_TYPES.items(), columns)})

    tile = [F.floor(F.col(c) / _TILE).alias(name) for c, name in (("tx", "ti"), ("ty", "tj"))]
    return rows.withColumns(dict(zip(("ti", "tj"), tile))).groupBy("ti", "tj").applyInArrow(run, FIT_SCHEMA)


def expected_of_overlay(overlay: DataFrame, least: float = 0.2) -> DataFrame:
    """(tx, ty, signal_time, e) of the pixels that an overlay (dataset, frame, x, y, value) reaches with more than ``least`` of its
    largest value: its series over that value, and the first frame of its peak. For ``fit_pixels``, which fits all others without."""
    top = overlay.groupBy("dataset").agg(F.max("value").alias("top"))
    peak, frame = first_peak()
    series = F.array_sort(F.collect_list(F.struct("frame", "value")))
    rows = overlay.groupBy("dataset", "x", "y").agg(series.alias("s"), peak.alias("peak"), frame.cast("int").alias("signal_time")).join(top, "dataset").filter(F.col("peak") > least * F.col("top"))
    return rows.select(F.col("x").alias("tx"), F.col("y").alias("ty"), "signal_time", F.transform("s", lambda c: c["value"] / F.col("top")).alias("e"))


def fold_moments(pairs: DataFrame, cube: DataFrame, folds: int) -> DataFrame:
    """Additive statistics per target, predictor and fold: count, sums, squares and products. Train = total - fold."""
    a = cube.select(F.col("x").alias("tx"), F.col("y").alias("ty"), "frame", F.col("value").alias("b"))
    p = cube.select("x", "y", "frame", F.col("value").alias("a"))
    met = pairs.select("tx", "ty", "x", "y").join(a, ["tx", "ty"]).join(p, ["x", "y", "frame"])
    s = lambda e, n: F.sum(e).alias(n)
    ab, av, bv = F.col("a") * F.col("b"), F.col("a"), F.col("b")
    return met.groupBy("tx", "ty", "x", "y", F.pmod("frame", F.lit(folds)).alias("fold")).agg(F.count("*").alias("n"), s(av, "sa"), s(bv, "sb"), s(av * av, "saa"), s(ab, "sab"))


def moment_ridge(moments: DataFrame, penalty: float) -> DataFrame:
    """Slope of each target on one predictor for each held-out fold, from the moments alone."""
    w = Window.partitionBy("tx", "ty", "x", "y")
    train = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "sa", "sb", "saa", "sab")}
    cov = train["sab"] - train["sa"] * train["sb"] / train["n"]
    var = train["saa"] - train["sa"] * train["sa"] / train["n"]
    return moments.withColumn("slope", F.try_divide(cov, var + penalty))


#: Up to so many frames the whole frame-by-frame product is taken at once; beyond, a range finder of EXTRA columns more than components and PASSES passes.
EXACT_FRAMES, EXTRA, PASSES = 512, 16, 4
_BLOCK, _BRANCHES = 256, 32


def _dense(pdf: pd.DataFrame, frames: np.ndarray) -> np.ndarray:
    """One row per pixel over all frames, less its mean; frames that a pixel lacks count as its mean."""
    d = np.zeros((len(pdf), len(frames)))
    for i, (f, v) in enumerate(zip(pdf.f, pdf.v)):
        values = np.asarray(v, float)
        d[i, np.searchsorted(frames, f)] = values - values.mean()
    return d


def frame_product(pixels: DataFrame, frames: np.ndarray, right: np.ndarray) -> np.ndarray:
    """D D' ``right`` for the matrix D of frames x pixels, ``pixels`` (f, v) as arrays.

    Each task sums over its pixels; the sums of blocks of frames are added up in two levels. The driver gets one row per block of frames.
    """
    shared = pixels.sparkSession.sparkContext.broadcast(right)
    k = right.shape[1]

    def part(parts):
        from pyspark import TaskContext

        total = np.zeros((len(frames), k))
        for pdf in parts:
            d = _dense(pdf, frames)
            total += d.T @ (d @ shared.value)
        for at in range(0, len(frames), _BLOCK):
            yield pd.DataFrame({"block": [at // _BLOCK], "branch": [TaskContext.get().partitionId() % _BRANCHES], "m": [total[at : at + _BLOCK].tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(m=[sum(np.frombuffer(m) for m in pdf.m).tobytes()])

    schema = "block int, branch int, m binary"
    sums = pixels.select("f", "v").mapInPandas(part, schema)
    for keys in (["block", "branch"], ["block"]):
        sums = sums.groupBy(*keys).applyInPandas(added, schema)
    blocks = {r.block: np.frombuffer(r.m).reshape(-1, k) for r in sums.collect()}
    return np.concatenate([blocks[i] for i in sorted(blocks)]) if blocks else np.zeros((len(frames), k))


def principal_frames(pixels: DataFrame, frames: np.ndarray, top: int, exact_frames: int = EXACT_FRAMES) -> np.ndarray:
    """The ``top`` leading left vectors of the matrix of frames x pixels: exact for few frames, else from a random range refined by passes."""
    n = len(frames)
    if n <= exact_frames:
        basis = np.eye(n)
        gram = frame_product(pixels, frames, basis)
    else:
        basis = np.linalg.qr(np.random.default_rng(7).normal(size=(n, min(n, top + EXTRA))))[0]
        for _ in range(PASSES):
            basis = np.linalg.qr(frame_product(pixels, frames, basis))[0]
        gram = basis.T @ frame_product(pixels, frames, basis)
    vectors = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]
    return basis @ vectors[:, :top]


def pca_residuals(cube: DataFrame, n_components: list[int], exact_frames: int = EXACT_FRAMES) -> tuple[DataFrame, DataFrame]:
    """(n, frame, x, y, value) after subtracting the rank-n reconstruction, and (component, frame, score).

    A pixel is one row with its series; a missing value counts as 0. The driver holds frames x components numbers (frames x frames up to ``exact_frames``).
    """
    from framewright.sources.tables import checkpointed

    spark = cube.sparkSession
    at = F.array_sort(F.collect_list(F.struct("frame", F.coalesce("value", F.lit(0.0)).alias("value"))))
    pixels = cube.groupBy("x", "y").agg(at.alias("s")).select("x", "y", F.col("s.frame").alias("f"), F.col("s.value").alias("v"))
    frames = np.array([r["frame"] for r in cube.select("frame").distinct().orderBy("frame").collect()], np.int64)  # one number a frame
    if len(frames) > exact_frames:
        pixels = checkpointed(pixels)
    top = min(max(n_components), len(frames))
    u = principal_frames(pixels, frames, top, exact_frames)
    shared = spark.sparkContext.broadcast((frames, u))
    ranks = sorted({n for n in n_components if n <= top})

    def less(parts):
        frames, u = shared.value
        for pdf in parts:
            d = _dense(pdf, frames)
            c = d @ u
            for n in ranks:
                left = d - c[:, :n] @ u[:, :n].T
                yield pd.DataFrame({"n": n, "x": pdf.x, "y": pdf.y, "f": list(pdf.f), "r": [row[np.searchsorted(frames, f)] for row, f in zip(left, pdf.f)]})

    rows = pixels.mapInPandas(less, "n int, x int, y int, f array<int>, r array<double>")
    rows = rows.select("n", "x", "y", F.explode(F.arrays_zip("f", "r")).alias("c")).select("n", F.col("c.f").alias("frame"), "x", "y", F.col("c.r").alias("value"))
    scores = [(k, int(f), float(u[i, k])) for k in range(top) for i, f in enumerate(frames)]
    return rows, spark.createDataFrame(scores, "component int, frame int, score double")


def clustered(series: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(x, y, cluster) of series scaled to mean 0 and deviation 1."""
    size = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda s, e: s + e) / size
    sd = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + F.pow(e - F.col("mean"), 2)) / size)
    rows = series.select("x", "y", "v", mean.alias("mean")).withColumn("sd", sd)
    scaled = F.transform("v", lambda e: (e - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    rows = rows.select("x", "y", array_to_vector(scaled).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("x", "y", F.col("prediction").alias("cluster"))


def spline_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives at the knots of the cubic spline with continuous second derivatives (third ones at the second knots from the ends)."""
    n = len(t)
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    if n < 4:
        return np.gradient(y, t) if n > 1 else np.zeros(n)
    low, mid, up, rhs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    rhs[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    mid[0], up[0], rhs[0] = h[1], h[0] + h[1], ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    mid[-1], low[-1] = h[-2], h[-1] + h[-2]
    rhs[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    for i in range(1, n):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    s = np.zeros(n)
    s[-1] = rhs[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        s[i] = (rhs[i] - up[i] * s[i + 1]) / mid[i]
    return s


def interpolated(integrals: DataFrame, times: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """(parameter, t, value): derivative at ``times`` (parameter, t) of the one spline through (parameter, t, integral) of all readings of a parameter."""
    return spline_derivatives(integrals.select("parameter", "t", F.col("integral").alias("y")), times, float(chunk_seconds))
