"""Resampling on whole frames and templates: cubic splines, template tables along rotated paths, exact apertures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.coords import center, rotated
from framewright.operators.joins import near_pairs

_POLE = math.sqrt(3) - 2


def spline_coefficients(rows: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through the samples along the last axis, mirrored about its ends: a recursion forward and one back."""
    n = rows.shape[-1]
    if n < 2:
        return rows.astype(float)
    c = rows.astype(float) * 6
    powers = _POLE ** np.arange(n)
    whole = np.concatenate([c, c[..., -2:0:-1]], -1)  # one period of the mirrored samples
    c[..., 0] = (whole * np.concatenate([powers, _POLE ** np.arange(n, 2 * n - 2)])).sum(-1) / (1 - _POLE ** (2 * n - 2))
    for k in range(1, n):
        c[..., k] += _POLE * c[..., k - 1]
    c[..., -1] = _POLE / (_POLE * _POLE - 1) * (c[..., -1] + _POLE * c[..., -2])
    for k in range(n - 2, -1, -1):
        c[..., k] = _POLE * (c[..., k + 1] - c[..., k])
    return c


def _weights(t: np.ndarray) -> np.ndarray:
    """Shares of the four coefficients around a place at distance t from the second one."""
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)


def spline_samples(frame: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Values of the cubic spline through a frame at (px, py), from 16 coefficients each; zero outside of it."""
    c = spline_coefficients(spline_coefficients(frame).T).T
    sx, sy = frame.shape
    i, j = np.floor(px).astype(int), np.floor(py).astype(int)
    wx, wy = _weights(px - i), _weights(py - j)
    out = np.zeros(px.shape)
    for a in range(4):
        for b in range(4):
            out += wx[a] * wy[b] * c[_mirrored(i + a - 1, sx), _mirrored(j + b - 1, sy)]
    edge = 1e-9
    inside = (px >= -edge) & (px <= sx - 1 + edge) & (py >= -edge) & (py <= sy - 1 + edge)
    return np.where(inside, out, 0.0)


def derotated_cubic(cube: DataFrame, frames: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """Each frame turned so that a source that moves with its angle stands still, by cubic splines; zero from outside, missing cells count as 0.

    A group is one frame, so its size is that of an image, whatever the length of the cube.
    """
    cx, cy = size_x / 2 - 0.5, size_y / 2 - 0.5
    rows = cube.select("dataset", "frame", "x", "y", "value").join(frames.select("dataset", "frame", "parang"), ["dataset", "frame"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = np.zeros((size_x, size_y))
        x, y = pdf.x.to_numpy(int), pdf.y.to_numpy(int)
        frame[x, y] = np.nan_to_num(pdf.value.to_numpy(float))
        phi = math.radians(-float(pdf.parang.iloc[0]))
        px = cx + (x - cx) * math.cos(phi) - (y - cy) * math.sin(phi)
        py = cy + (x - cx) * math.sin(phi) + (y - cy) * math.cos(phi)
        return pd.DataFrame({"dataset": pdf.dataset, "frame": pdf.frame, "x": x, "y": y, "value": spline_samples(frame, px, py)})

    kind = {f.name: f.dataType.simpleString() for f in cube.schema}
    return rows.groupBy("dataset", "frame").applyInPandas(run, f"dataset {kind['dataset']}, frame int, x int, y int, value double")


def template_arrays(templates: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """(dataset, template): each template (dataset, x, y, value) as one array, row by row; a missing cell is 0."""
    cell = F.struct((F.col("x") * size_y + F.col("y")).cast("int").alias("k"), F.coalesce("value", F.lit(0.0)).alias("v"))
    values = templates.groupBy("dataset").agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    at = F.sequence(F.lit(0), F.lit(size_x * size_y - 1))
    return values.select("dataset", F.transform(at, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("template"))


def template_value(template: Column, u: Column, w: Column, size_x: int, size_y: int) -> Column:
    """Bilinear value of a template array at (u, w); zero outside."""
    i, j = F.floor(u).cast("int"), F.floor(w).cast("int")
    fu, fw = u - i, w - j

    def cell(a: int, b: int, share: Column) -> Column:
        inside = (i + a).between(0, size_x - 1) & (j + b).between(0, size_y - 1)
        return F.when(inside, share * F.get(template, (i + a) * size_y + (j + b))).otherwise(F.lit(0.0))

    return cell(0, 0, (1 - fu) * (1 - fw)) + cell(1, 0, fu * (1 - fw)) + cell(0, 1, (1 - fu) * fw) + cell(1, 1, fu * fw)


def template_series(targets: DataFrame, frames: DataFrame, templates: DataFrame, size_x: int, size_y: int, template_x: int, template_y: int) -> DataFrame:
    """Signal over time that (dataset, tx, ty, signal_time) would see of a source that is there at that time: the template table of its dataset,
    read where the source's path leaves the pixel, over its largest value. NULL where the path has left the frame.

    What a whole cube with the source stamped in would have at the pixel, without the cube.
    """
    at = frames.select("dataset", F.col("frame").alias("signal_time"), F.col("parang").alias("a0"))
    rows = targets.join(at, ["dataset", "signal_time"]).join(frames.select("dataset", "frame", "parang"), "dataset")
    px, py = rotated(F.col("tx"), F.col("ty"), center(size_x), center(size_y), F.col("parang") - F.col("a0"))
    rows = rows.withColumn("px", px).withColumn("py", py).join(template_arrays(templates, template_x, template_y), "dataset")
    u, w = F.col("tx") - F.col("px") + (template_x - 1) / 2, F.col("ty") - F.col("py") + (template_y - 1) / 2
    inside = F.col("px").between(0, size_x - 1) & F.col("py").between(0, size_y - 1)
    value = F.when(inside, template_value(F.col("template"), u, w, template_x, template_y))
    rows = rows.select("dataset", "tx", "ty", "signal_time", "frame", value.alias("value"))
    top = F.max("value").over(Window.partitionBy("dataset", "tx", "ty", "signal_time"))
    return rows.select("dataset", "tx", "ty", "signal_time", "frame", F.try_divide("value", top).alias("expected"))


def _below(x: Column, y: Column, r: float) -> Column:
    """Area of the part of a disk about the origin that lies left of x and below y."""
    x, y = F.greatest(F.least(x, F.lit(r)), F.lit(-r)), F.greatest(F.least(y, F.lit(r)), F.lit(-r))
    segment = lambda c: c * F.sqrt(F.greatest(r * r - c * c, F.lit(0.0))) + r * r * F.asin(c / r) + math.pi * r * r / 2
    outside = F.when((x <= 0) & (y <= 0), F.lit(0.0)).when((x > 0) & (y > 0), segment(x) + segment(y) - math.pi * r * r).when(x > 0, segment(y)).otherwise(segment(x))
    within = x * y + (segment(x) + segment(y)) / 2 - math.pi * r * r / 4
    return F.when(x * x + y * y >= r * r, outside).otherwise(within)


def exact_overlap(dx: Column, dy: Column, radius: float) -> Column:
    """Area of a pixel inside a circle of ``radius``; offsets are pixel minus centre."""
    r = float(radius)
    return _below(dx + 0.5, dy + 0.5, r) - _below(dx - 0.5, dy + 0.5, r) - _below(dx + 0.5, dy - 0.5, r) + _below(dx - 0.5, dy - 0.5, r)


def exact_sums(maps: DataFrame, positions: DataFrame, radius: float, keys: list[str], by: list[str]) -> DataFrame:
    """Flux in a circle at (px, py), each pixel by its exact area inside it; missing values count as 0."""
    near = near_pairs(positions.withColumnsRenamed({"px": "tx", "py": "ty"}), maps.select(*keys, "x", "y", "value"), radius + 1.0, keys)
    share = exact_overlap(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"), radius)
    return near.groupBy(*by).agg(F.sum(share * F.coalesce("value", F.lit(0.0))).alias("flux"))
