"""Running sums, row numbers, neighbours and splines along long axes, in two passes over tiles of the axis.

The first pass sums up each tile; what a tile takes over from the ones before (or after) it comes from a window over tiles, which are far fewer than
rows; the second pass works inside each tile. No task gets all rows of a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], tile: str = "_tile"):
    return Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: list[str], order: list[str], tile: Column, name: str = "number") -> DataFrame:
    """``rows`` with their number from 0 in each key by ``order``, of which ``tile`` is a non-falling function; a last column ``_n`` has the rows of the key."""
    rows = rows.withColumn("_tile", tile)
    sizes = rows.groupBy(*keys, "_tile").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0))).withColumn("_n", F.sum("_size").over(Window.partitionBy(*keys))).drop("_size")
    own = F.row_number().over(Window.partitionBy(*keys, "_tile").orderBy(*order)) - 1
    return rows.withColumn(name, own).join(offsets, [*keys, "_tile"]).withColumn(name, F.col(name) + F.col("_start")).drop("_tile", "_start")


def running_areas(rows: DataFrame, key: str, t: str, value: str, width: float) -> DataFrame:
    """``rows`` with ``integral``: the sum over earlier rows of their value times the time to the next one; no value may be missing."""
    rows = rows.withColumn("_tile", F.floor(F.col(t) / width))
    w = Window.partitionBy(key, "_tile").orderBy(t)
    area = F.lag(value).over(w) * (F.col(t) - F.lag(t).over(w))
    rows = rows.withColumn("_area", F.coalesce(area, F.lit(0.0)))
    ends = F.max(F.struct(t, F.col(value).alias("v"))).alias("_last")
    tiles = rows.groupBy(key, "_tile").agg(F.sum("_area").alias("_sum"), F.min(t).alias("_first"), ends)
    order = Window.partitionBy(key).orderBy("_tile")
    before = F.lag("_last").over(order)
    tiles = tiles.withColumn("_gap", F.coalesce(before["v"] * (F.col("_first") - before[t]), F.lit(0.0)))
    tiles = tiles.withColumn("_start", F.col("_gap") + F.coalesce(F.sum(F.col("_sum") + F.col("_gap")).over(_before([key])), F.lit(0.0)))
    inside = F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(tiles.select(key, "_tile", "_start"), [key, "_tile"]).withColumn("integral", F.col("_inside") + F.col("_start")).drop("_tile", "_area", "_inside", "_start")


def bracketed(values: DataFrame, points: DataFrame, at: str, point: str, keys: list[str], width: float) -> DataFrame:
    """``values`` with ``below`` and ``above``: the last row of ``points`` at or before ``at`` and the first at or after it, as structs (``point`` first); NULL without one."""
    others = [c for c in points.columns if c not in keys and c != point]
    mine = F.struct(F.col(point).cast("double").alias("at"), *others)
    p = points.select(*keys, F.floor(F.col(point) / width).alias("_tile"), F.col(point).cast("double").alias("_at"), mine.alias("_point"))
    v = values.withColumn("_at", F.col(at).cast("double")).withColumn("_tile", F.floor(F.col("_at") / width)).withColumn("_row", F.lit(True))
    borders = p.select(*keys, "_tile", "_point").unionByName(v.select(*keys, "_tile").distinct(), allowMissingColumns=True).groupBy(*keys, "_tile").agg(F.max("_point").alias("_high"), F.min("_point").alias("_low"))
    # what follows is taken over the rows in falling order: a frame that ends at the end of its window is gone through anew for every row
    after = Window.partitionBy(*keys).orderBy(F.desc("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.select(*keys, "_tile", F.max("_high").over(_before(keys)).alias("_left"), F.min("_low").over(after).alias("_right"))
    tile, so_far = Window.partitionBy(*keys, "_tile"), (Window.unboundedPreceding, Window.currentRow)
    both = v.unionByName(p, allowMissingColumns=True)
    both = both.withColumn("_below", F.max("_point").over(tile.orderBy("_at").rangeBetween(*so_far)))
    both = both.withColumn("_above", F.min("_point").over(tile.orderBy(F.desc("_at")).rangeBetween(*so_far))).filter("_row").drop("_point", "_row", "_at")
    met = both.join(carried, [*keys, "_tile"])
    return met.withColumn("below", F.coalesce("_below", "_left")).withColumn("above", F.coalesce("_above", "_right")).drop("_tile", "_below", "_above", "_left", "_right")


#: Knots of a tile of a spline.
KNOTS = 4096


def _rows_of(t: np.ndarray, y: np.ndarray, first: bool, last: bool) -> tuple[np.ndarray, ...]:
    """Lower, middle and upper diagonal and right-hand side of the slopes at the knots t[1:-1] (at the ends of the whole: at all of t)."""
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    low, mid, up = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    rhs = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    if first:  # third derivatives agree at the second knot
        low, mid, up = np.append(0.0, low), np.append(h[1], mid), np.append(h[0] + h[1], up)
        rhs = np.append(((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1]), rhs)
    if last:
        low, mid, up = np.append(low, h[-1] + h[-2]), np.append(mid, h[-2]), np.append(up, 0.0)
        rhs = np.append(rhs, (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2]))
    return low, mid, up, rhs


def _tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions for the columns of ``rhs``."""
    mid, rhs = mid.copy(), rhs.copy()
    n = len(mid)
    for i in range(1, n):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    rhs[-1] /= mid[-1]
    for i in range(n - 2, -1, -1):
        rhs[i] = (rhs[i] - up[i] * rhs[i + 1]) / mid[i]
    return rhs


def spline_slopes(knots: DataFrame, key: str = "parameter", width: float = 86400.0, size: int = KNOTS) -> DataFrame:
    """(key, t, y, slope) of the one cubic spline through all knots (key, t, y) of a key, third derivatives continuous at the second knots from the ends.

    Tiles of ``size`` knots solve their rows of the tridiagonal system for three right-hand sides: their own, and one for each neighbour's
    border slope. The border slopes of all tiles form a small system per key, two numbers a tile; then every tile puts its own together.
    Keys of one knot have slope 0, of two or three the slopes of the line or parabola through them. Of equal times one knot counts.
    """
    rows = numbered(knots.groupBy(key, "t").agg(F.min("y").alias("y")), [key], ["t"], F.floor(F.col("t") / width))
    rows = rows.withColumn("tile", F.least(F.floor(F.col("number") / size), F.greatest(F.floor(F.col("_n") / size) - 1, F.lit(0))).cast("int"))
    place = F.struct("t", "y")
    edges = rows.groupBy(key, "tile").agg(F.min(place).alias("head"), F.max(place).alias("tail"))
    order = Window.partitionBy(key).orderBy("tile")
    edges = edges.select(key, "tile", F.lag("tail").over(order).alias("left"), F.lead("head").over(order).alias("right"))
    parts = rows.join(edges, [key, "tile"]).select(key, "tile", "t", "y", F.col("left.t").alias("lt"), F.col("left.y").alias("ly"), F.col("right.t").alias("rt"), F.col("right.y").alias("ry"))
    kind = knots.schema[key].dataType.simpleString()

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, y = pdf.t.to_numpy(float), pdf.y.to_numpy(float)
        first, last = bool(np.isnan(pdf["lt"].iloc[0])), bool(np.isnan(pdf["rt"].iloc[0]))
        if first and last and len(t) < 4:
            g = np.zeros(1) if len(t) == 1 else np.full(2, (y[1] - y[0]) / (t[1] - t[0])) if len(t) == 2 else np.polyval(np.polyder(np.polyfit(t - t[0], y - y[0], 2)), t - t[0])
            return pdf.assign(g=g, v=0.0, w=0.0)[[key, "tile", "t", "y", "g", "v", "w"]]
        a = t if first else np.append(pdf["lt"].iloc[0], t)
        b = y if first else np.append(pdf["ly"].iloc[0], y)
        if not last:
            a, b = np.append(a, pdf["rt"].iloc[0]), np.append(b, pdf["ry"].iloc[0])
        low, mid, up, rhs = _rows_of(a - t[0], b - y[0], first, last)
        sides = np.zeros((len(t), 3))
        sides[:, 0] = rhs
        sides[0, 1] = 0.0 if first else low[0]
        sides[-1, 2] = 0.0 if last else up[-1]
        g, v, w = _tridiagonal(low, mid, up, sides).T
        return pdf.assign(g=g, v=v, w=w)[[key, "tile", "t", "y", "g", "v", "w"]]

    solved = parts.groupBy(key, "tile").applyInPandas(local, f"{key} {kind}, tile int, t double, y double, g double, v double, w double")
    one = F.struct("t", "g", "v", "w")
    borders = solved.groupBy(key, "tile").agg(F.min(one).alias("head"), F.max(one).alias("tail"))
    borders = borders.select(key, "tile", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("head", "tail") for c in ("g", "v", "w")])

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        """Border slopes: those of a tile's first and last knot are linear in the last one of the tile before and the first one of the next."""
        pdf = pdf.sort_values("tile")
        n = len(pdf)
        # unknowns in order: first and last slope of each tile; eliminated from left to right, two rows a tile
        right_of = np.zeros((n, 2, 2))  # (first, last) = c + right_of @ (0, first of the next tile)
        c = np.zeros((n, 2))
        carry, slope = 0.0, 0.0  # last slope of the tile before = carry + slope * first slope of this one
        for k, r in enumerate(pdf.itertuples()):
            f = 1 + r.head_v * slope
            c[k, 0], right_of[k, 0, 1] = (r.head_g - r.head_v * carry) / f, -r.head_w / f
            left_c, left_s = carry + slope * c[k, 0], slope * right_of[k, 0, 1]
            c[k, 1], right_of[k, 1, 1] = r.tail_g - r.tail_v * left_c, -r.tail_w - r.tail_v * left_s
            carry, slope = c[k, 1], right_of[k, 1, 1]
        first, last, following = np.zeros(n), np.zeros(n), 0.0
        for k in range(n - 1, -1, -1):
            first[k], last[k] = c[k] + right_of[k, :, 1] * following
            following = first[k]
        return pd.DataFrame({key: pdf[key], "tile": pdf.tile, "before": np.append(0.0, last[:-1]), "after": np.append(first[1:], 0.0)})

    shared = borders.groupBy(key).applyInPandas(reduced, f"{key} {kind}, tile int, before double, after double")
    out = solved.join(shared, [key, "tile"])
    return out.select(key, "t", "y", (F.col("g") - F.col("v") * F.col("before") - F.col("w") * F.col("after")).alias("slope"))


def spline_derivatives(knots: DataFrame, times: DataFrame, width: float = 86400.0, size: int = KNOTS) -> DataFrame:
    """(parameter, t, value): derivative at ``times`` (parameter, t) of the one spline through (parameter, t, y); NULL outside of its knots."""
    met = bracketed(times, spline_slopes(knots, "parameter", width, size), "t", "t", ["parameter"], width)
    a, b = F.col("below"), F.col("above")
    h = b["at"] - a["at"]
    u = (F.col("t") - a["at"]) / h
    inside = 6 * (b["y"] - a["y"]) / h * u * (1 - u) + a["slope"] * (1 - 4 * u + 3 * u * u) + b["slope"] * (3 * u * u - 2 * u)
    return met.select("parameter", "t", F.when(a.isNotNull() & b.isNotNull(), F.when(h > 0, inside).otherwise(a["slope"])).alias("value"))
