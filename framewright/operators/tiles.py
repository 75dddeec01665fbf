"""Regressions of all pixels of a tile in one group: pixels with their halo, covariates gated by signal time, all signal times in one run.

A tile is a square of target pixels; its halo holds every pixel that may predict one of them. A pixel's series goes to the few tiles around it
and around its mirror image instead of to every target that uses it. In a tile, each fold standardises all series once and takes one Gram matrix,
of which every target uses its own block; a target's block is factored once per fold and bordered by what differs between signal times.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.models import least_squares


class PredictorMask(NamedTuple):
    """Which pixels predict a target: near it or near its mirror image, but not too near it. Radii in pixels, strictly inside."""

    size_x: int
    size_y: int
    r_target: float
    r_opposite: float
    r_excluded: float

    def of(self, x: np.ndarray, y: np.ndarray, tx: int, ty: int) -> np.ndarray:
        d = (x - tx) ** 2 + (y - ty) ** 2
        mirror = (x - (self.size_x - 1 - tx)) ** 2 + (y - (self.size_y - 1 - ty)) ** 2
        return ((d < self.r_target**2) | (mirror < self.r_opposite**2)) & ~(d < self.r_excluded**2)


class Factor(NamedTuple):
    """Left vectors, singular values and right vectors of a block of centred columns."""

    u: np.ndarray
    s: np.ndarray
    vt: np.ndarray


def factored(a: np.ndarray, gram: np.ndarray) -> Factor:
    """From the smaller of the two products: ``gram`` = a'a if there are fewer columns than rows, else aa'."""
    if a.shape[1] <= a.shape[0]:
        values, q = np.linalg.eigh(gram)
    else:
        values, q = np.linalg.eigh(a @ a.T)
    keep = values > values.max(initial=0) * max(a.shape) * np.finfo(float).eps * 8
    s, q = np.sqrt(values[keep]), q[:, keep]
    if a.shape[1] <= a.shape[0]:
        return Factor(a @ q / s, s, q.T)
    return Factor(q, s, (a.T @ q / s).T)


def bordered(f: Factor, b: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least squares on the factored block and the columns ``b`` together, by the Schur complement of the block.

    Coefficients of the block and of ``b``, residuals, and the diagonal of the hat matrix (without the mean).
    """
    shrink = f.s**2 / (f.s**2 + penalty)
    ub, uy = f.u.T @ b, f.u.T @ y
    rest_b = b - f.u @ (shrink[:, None] * ub)
    schur = np.linalg.pinv(b.T @ rest_b + penalty * np.eye(b.shape[1]), rcond=1e-12, hermitian=True)
    cb = schur @ (rest_b.T @ y)
    ca = f.vt.T @ (f.s / (f.s**2 + penalty) * (uy - ub @ cb))
    residual = y - f.u @ (shrink * uy) - rest_b @ cb
    leverage = (f.u**2 * shrink).sum(1) + ((rest_b @ schur) * rest_b).sum(1)
    return ca, cb, residual, leverage


def solved(f: Factor, b: np.ndarray, y: np.ndarray, model: str, alphas) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of block and border, and the penalty: none, the first one, or the one of the least mean squared leave-one-out residual."""
    if model == "LinearRegression":
        alpha = 0.0
        if len(f.s) < f.vt.shape[1] or len(f.s) + b.shape[1] >= len(y):  # more than one solution: the shortest
            c = least_squares(np.column_stack([f.u * f.s @ f.vt, b]), y)
            return c[: f.vt.shape[1]], c[f.vt.shape[1] :], alpha
    elif model == "Ridge":
        alpha = float(alphas[0])
    else:
        errors = []
        for a in alphas:
            _, _, r, h = bordered(f, b, y, a)
            errors.append(np.mean((r / np.maximum(1 - h - 1 / len(y), 1e-12)) ** 2))
        alpha = float(alphas[int(np.argmin(errors))])
    ca, cb, _, _ = bordered(f, b, y, alpha)
    return ca, cb, alpha


def admissible(expected: np.ndarray | None, covariates: np.ndarray, most: float) -> np.ndarray:
    """Which covariates (columns) may predict under an expected signal: all without one, or if it has a missing value or does not vary;
    else those whose correlation with it is at most ``most``. One that does not vary is out then."""
    q = covariates.shape[1]
    if expected is None or np.isnan(expected).any() or expected.min() == expected.max():
        return np.ones(q, bool)
    d, e = covariates - covariates.mean(0), expected - expected.mean()
    size = np.sqrt((d**2).sum(0) * (e**2).sum())
    return (size > 0) & (np.abs(d.T @ e) <= most * size)


def _scaled(x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the train rows of each column; no deviation counts as 1."""
    sd = x[train].std(0)
    return x[train].mean(0), np.where(sd == 0, 1, sd)


class _Block(NamedTuple):
    """A set of train rows with all series of the tile standardised on them, and their Gram matrix."""

    train: np.ndarray
    z: np.ndarray
    gram: np.ndarray


def _block(v: np.ndarray, train: np.ndarray) -> _Block:
    mean, sd = _scaled(v, train)
    z = (v - mean) / sd
    return _Block(train, z, z[train].T @ z[train])


LEAST_TRAINED = 0.33  # share of the train rows that masking must leave
CALM = 0.2  # expected signal from which on a row is masked
SIGNAL_SCALE = 1000.0  # keeps penalties off the share of the signal


def fit_target(v: np.ndarray, blocks: list[_Block], chosen: np.ndarray, y: np.ndarray, covariates: np.ndarray, signals: list[tuple[int | None, np.ndarray | None]], mode: str, model: str, alphas, most: float) -> list[dict]:
    """One result per signal time (None: the default model) for a target ``y`` and the columns ``chosen`` of ``v``."""
    n, folds = len(y), len(blocks)
    fits = []
    for time, e in signals:
        use = admissible(e, covariates, most)
        flat = None if e is None else np.nan_to_num(e)
        fits.append({"time": time, "e": flat, "use": use, "residual": np.full(n, np.nan), "ca": np.zeros(len(chosen)), "cb": np.zeros(len(use)), "signal": [], "penalty": []})
    whole = np.isfinite(y).all()
    for k, shared in enumerate(blocks):
        apply = np.arange(n) % folds == k if folds > 1 else np.ones(n, bool)
        train = shared.train & np.isfinite(y)
        if train.sum() < 2:
            continue
        block = shared if whole else _block(v[:, chosen], train)
        columns = chosen if whole else np.arange(len(chosen))
        kept: dict[bytes, tuple[_Block, np.ndarray, Factor]] = {}
        for fit in fits:
            if fit["residual"] is None:
                continue
            rows, own, at = train, block, columns
            if mode == "signal_masking" and fit["e"] is not None:
                rows = train & ~(fit["e"] >= CALM)
                if rows.sum() < LEAST_TRAINED * train.sum():
                    fit["residual"] = None
                    continue
                if rows.sum() < train.sum():
                    own, at = None, np.arange(len(chosen))
            key = rows.tobytes()
            if key not in kept:
                own = own or _block(v[:, chosen], rows)
                kept[key] = own, at, factored(own.z[rows][:, at], own.gram[np.ix_(at, at)])
            own, at, factor = kept[key]
            my, sy = y[rows].mean(), y[rows].std() or 1.0
            target = (y[rows] - my) / sy
            mean, sd = _scaled(covariates, rows)
            c = ((covariates - mean) / sd)[:, fit["use"]]
            base, share = 0.0, np.nan
            if mode == "signal_fitting" and fit["e"] is not None:
                e = fit["e"] * SIGNAL_SCALE
                me = e[rows].mean()
                ca, cb, alpha = solved(factor, np.column_stack([c[rows], e[rows] - me]), target, model, alphas)
                share = cb[-1] * SIGNAL_SCALE * sy
                base, cb = -cb[-1] * me, cb[:-1]
                if share < 0:
                    base = 0.0
                    ca, cb, alpha = solved(factor, c[rows], target, model, alphas)
            else:
                ca, cb, alpha = solved(factor, c[rows], target, model, alphas)
            prediction = own.z[apply][:, at] @ ca + c[apply] @ cb + base
            fit["residual"][apply] = y[apply] - prediction * sy - my
            fit["ca"] += ca / folds
            fit["cb"][fit["use"]] += cb / folds
            fit["signal"].append(share)
            fit["penalty"].append(alpha)
    return fits


FIT_SCHEMA = "dataset string, tx int, ty int, signal_time int, residual array<double>, px array<int>, py array<int>, coefficients array<double>, keys array<string>, key_coefficients array<double>, signal double, penalty double"


def halo(pixels: DataFrame, mask: PredictorMask, width: int) -> DataFrame:
    """``pixels`` once per tile (ti, tj) with a target that they may predict: tiles within reach of the pixel and of its mirror image."""

    def reached(x: Column, y: Column, r: float) -> Column:
        low = lambda c: F.floor((c - r) / width).cast("int")
        high = lambda c: F.floor((c + r) / width).cast("int")
        return F.flatten(F.transform(F.sequence(low(x), high(x)), lambda i: F.transform(F.sequence(low(y), high(y)), lambda j: F.struct(i.alias("ti"), j.alias("tj")))))

    x, y = F.col("x"), F.col("y")
    tiles = F.concat(reached(x, y, max(mask.r_target, 0.0)), reached(mask.size_x - 1 - x, mask.size_y - 1 - y, mask.r_opposite))
    return pixels.select("*", F.explode(F.array_distinct(tiles)).alias("tile")).select("*", "tile.ti", "tile.tj").drop("tile")


def fit_tiles(series: DataFrame, targets: DataFrame, mask: PredictorMask, expected: DataFrame | None = None, covariates: DataFrame | None = None, folds: int = 3, model: str = "RidgeCV", alphas=(1.0,), mode: str = "default", most: float = 0.5, width: int = 8) -> DataFrame:
    """One row per target for the default model (signal_time NULL) and one for each of its signal times.

    ``series`` (dataset, x, y, v), ``targets`` (dataset, tx, ty), ``expected`` (dataset, tx, ty, signal_time, e) as series, ``covariates``
    (dataset, frame, key, value): predictors of every pixel, except where they are too much like the expected signal. Missing values
    of predictors are filled by the mean of their series; frames without a target value are neither fitted nor predicted. A masked model with
    too few rows left has no residual. ``mode``: default, signal_fitting or signal_masking.
    """
    tile = [F.floor(F.col(c) / width).cast("int").alias(t) for c, t in (("tx", "ti"), ("ty", "tj"))]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    t = targets.select("dataset", *tile, F.lit(1).alias("kind"), F.col("tx").alias("x"), F.col("ty").alias("y"), none("int", "time"), none("string", "key"), none("array<int>", "f"), none("array<double>", "v"))
    tiles = t.select("dataset", "ti", "tj").distinct()
    p = halo(series.select("dataset", "x", "y", F.col("v").cast("array<double>").alias("v")), mask, width).join(tiles, ["dataset", "ti", "tj"], "left_semi")
    rows = t.unionByName(p.select("dataset", "ti", "tj", F.lit(0).alias("kind"), "x", "y", none("int", "time"), none("string", "key"), none("array<int>", "f"), "v"))
    if expected is not None:
        e = expected.select("dataset", *tile, F.lit(2).alias("kind"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("signal_time").cast("int").alias("time"), none("string", "key"), none("array<int>", "f"), F.col("e").cast("array<double>").alias("v"))
        rows = rows.unionByName(e.join(tiles, ["dataset", "ti", "tj"], "left_semi").select(*rows.columns))
    if covariates is not None:
        at = F.array_sort(F.collect_list(F.struct("frame", F.col("value").cast("double").alias("value"))))
        c = covariates.groupBy("dataset", "key").agg(at.alias("s")).select("dataset", "key", F.col("s.frame").cast("array<int>").alias("f"), F.col("s.value").alias("v"))
        c = tiles.join(c, "dataset").withColumns({"kind": F.lit(3), "x": F.lit(None).cast("int"), "y": F.lit(None).cast("int"), "time": F.lit(None).cast("int")})
        rows = rows.unionByName(c)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        as_array = lambda v: np.array([[np.nan if z is None else z for z in a] for a in v], float)
        pix = pdf[pdf.kind == 0].sort_values(["x", "y"])
        aims = pdf[pdf.kind == 1].sort_values(["x", "y"]).drop_duplicates(["x", "y"])
        out = []
        raw = as_array(pix.v).T if len(pix) else np.zeros((0, 0))
        n = len(raw)
        fill = np.nan_to_num(np.nanmean(np.where(np.isfinite(raw).any(0), raw, 0.0), axis=0)) if n else raw
        v = np.where(np.isfinite(raw), raw, fill)
        given = pdf[pdf.kind == 3].sort_values("key")
        c = np.full((n, len(given)), np.nan)
        for k, (f, values) in enumerate(zip(given.f, given.v)):
            ok = np.asarray(f) < n
            c[np.asarray(f)[ok], k] = np.array([np.nan if z is None else z for z in values], float)[ok]
        c = np.where(np.isfinite(c), c, np.nan_to_num(np.nanmean(np.where(np.isfinite(c).any(0), c, 0.0), axis=0))) if n and len(given) else np.zeros((n, len(given)))
        keys = given.key.to_numpy()
        blocks = [_block(v, np.arange(n) % folds != k if folds > 1 else np.ones(n, bool)) for k in range(folds)] if n else []
        signals: dict[tuple, list] = {}
        for r in pdf[pdf.kind == 2].sort_values(["x", "y", "time"]).itertuples():
            signals.setdefault((r.x, r.y), []).append((int(r.time), as_array([r.v])[0]))
        x, y = pix.x.to_numpy(int), pix.y.to_numpy(int)
        for tx, ty in zip(aims.x.astype(int), aims.y.astype(int)):
            own = np.flatnonzero((x == tx) & (y == ty))
            chosen = np.flatnonzero(mask.of(x, y, tx, ty))
            if not len(own) or not (len(chosen) or len(keys)):
                continue
            cases = [(None, None), *(signals.get((tx, ty), []) if mode != "default" else [])]
            for fit in fit_target(v, blocks, chosen, raw[:, own[0]], c, cases, mode, model, alphas, most):
                done = fit["residual"] is not None and len(fit["penalty"]) > 0
                residual = [None if np.isnan(z) else float(z) for z in fit["residual"]] if done else None
                mean = lambda z: float(np.mean(z)) if done and not np.isnan(z).any() else None
                coefficients, more = (fit["ca"].tolist(), fit["cb"][fit["use"]].tolist()) if done else (None, None)
                out.append((pdf.dataset.iloc[0], tx, ty, fit["time"], residual, x[chosen].tolist(), y[chosen].tolist(), coefficients, keys[fit["use"]].tolist(), more, mean(fit["signal"]), mean(fit["penalty"])))
        frame = pd.DataFrame(out, columns=[name.split()[0] for name in FIT_SCHEMA.split(", ")])
        return frame.astype({"signal_time": "Int32"})

    return rows.groupBy("dataset", "ti", "tj").applyInPandas(run, FIT_SCHEMA)
