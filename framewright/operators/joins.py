"""Joins of pixels, frames, templates and dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.coords import center, flux_ratio, rotated
from framewright.operators.masks import circle
from framewright.operators.scans import bracketed


def _tile(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("int")


def near_pairs(targets: DataFrame, pixels: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Each target (tx, ty, ...) with the pixels (x, y, ...) strictly within ``radius``: tiles make it an equi-join."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    t = targets.withColumn("_i", F.explode(F.transform(around, lambda k: _tile(F.col("tx"), radius) + k)))
    t = t.withColumn("_j", F.explode(F.transform(around, lambda k: _tile(F.col("ty"), radius) + k)))
    p = pixels.withColumn("_i", _tile(F.col("x"), radius)).withColumn("_j", _tile(F.col("y"), radius))
    return t.join(p, [*keys, "_i", "_j"]).filter(circle(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"), radius)).drop("_i", "_j")


def predictor_pairs(targets: DataFrame, pixels: DataFrame, size_x: int, size_y: int, r_target: float, r_opposite: float, r_excluded: float, keys: list[str]) -> DataFrame:
    """(tx, ty, x, y): pixels near the target or near its mirror image, the target's own surroundings left out."""
    near = near_pairs(targets, pixels, r_target, keys)
    mirror = targets.select(*keys, F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), (F.lit(size_x - 1) - F.col("tx")).alias("tx"), (F.lit(size_y - 1) - F.col("ty")).alias("ty"))
    far = near_pairs(mirror, pixels, r_opposite, keys).select(*keys, F.col("_tx").alias("tx"), F.col("_ty").alias("ty"), "x", "y")
    both = near.select(*keys, "tx", "ty", "x", "y").unionByName(far).distinct()
    return both.filter(~circle(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"), r_excluded))


def mirrored(cube: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """Each cell with the value of the point-mirrored cell."""
    other = cube.select("dataset", "frame", (F.lit(size_x - 1) - F.col("x")).cast("int").alias("x"), (F.lit(size_y - 1) - F.col("y")).cast("int").alias("y"), F.col("value").alias("opposite"))
    return cube.join(other, ["dataset", "frame", "x", "y"])


def unmatched_frames(cube: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames that only one side has."""
    have = cube.select("dataset", "frame").distinct().withColumn("in_cube", F.lit(True))
    want = frames.select("dataset", "frame").distinct().withColumn("in_frames", F.lit(True))
    return have.join(want, ["dataset", "frame"], "full").filter("in_cube is null or in_frames is null")


def nearest(values: DataFrame, grid: DataFrame, value: str, point: str, keys: list[str], width: float = 1024.0) -> DataFrame:
    """The nearest grid point of each value, the lower one on ties: neighbours found in tiles of ``width``, which know the points next to them."""
    met = bracketed(values, grid.select(*keys, point), value, point, keys, width)
    low, high = F.col("below.at"), F.col("above.at")
    return met.withColumn(point, F.when(high.isNull() | (F.col(value) - low <= high - F.col(value)), low).otherwise(high)).drop("below", "above")


def _cells(x: Column, y: Column, value: Column) -> Column:
    """The four cells around a point with their bilinear shares of a value."""
    i, j = F.floor(x).cast("int"), F.floor(y).cast("int")
    fx, fy = x - i, y - j
    cell = lambda a, b, w: F.struct((i + a).cast("int").alias("x"), (j + b).cast("int").alias("y"), (w * value).alias("v"))
    return F.array(cell(0, 0, (1 - fx) * (1 - fy)), cell(1, 0, fx * (1 - fy)), cell(0, 1, (1 - fx) * fy), cell(1, 1, fx * fy))


def shifted(frame: DataFrame, dx, dy, keys: list[str], size_x: int, size_y: int) -> DataFrame:
    """A map moved by a sub-pixel offset (bilinear, zero from outside)."""
    moved = frame.select(*keys, F.explode(_cells(F.col("x") + dx, F.col("y") + dy, F.col("value"))).alias("c")).select(*keys, "c.x", "c.y", "c.v")
    inside = F.col("x").between(0, size_x - 1) & F.col("y").between(0, size_y - 1)
    return moved.filter(inside).groupBy(*keys, "x", "y").agg(F.sum("v").alias("value"))


def sampled(cube: DataFrame, points: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Bilinear values of ``cube`` at (px, py) of ``points``; missing cells count as 0. ``keys`` join both; ``by`` identifies a point."""
    parts = points.select(*dict.fromkeys([*keys, *by]), F.explode(_cells(F.col("px"), F.col("py"), F.lit(1.0))).alias("c"))
    parts = parts.select("*", "c.x", "c.y", F.col("c.v").alias("w")).drop("c").withColumnsRenamed({"x": "_x", "y": "_y"})
    cells = cube.withColumnsRenamed({"x": "_x", "y": "_y"}).select(*keys, "_x", "_y", "value")
    return parts.join(cells, [*keys, "_x", "_y"], "left").groupBy(*by).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def derotated(cube: DataFrame, frames: DataFrame, size_x: int, size_y: int, order: int = 1) -> DataFrame:
    """Each frame turned so that a source that moves with its angle (see ``injected``) stands still; order 0 (nearest
    cell) or 1 (bilinear), zero from outside.

    A target cell looks up where it came from, so a cell is written once and frames never meet.
    """
    cx, cy = center(size_x), center(size_y)
    grid = cube.select("dataset", "frame", "x", "y").join(frames.select("dataset", "frame", "parang"), ["dataset", "frame"])
    px, py = rotated(F.col("x"), F.col("y"), cx, cy, -F.col("parang"))
    points = grid.select("dataset", "frame", F.col("x").alias("x0"), F.col("y").alias("y0"), px.alias("px"), py.alias("py"))
    if order == 0:
        near = points.select("dataset", "frame", "x0", "y0", F.floor(F.col("px") + 0.5).cast("int").alias("x"), F.floor(F.col("py") + 0.5).cast("int").alias("y"))
        met = near.join(cube.select("dataset", "frame", "x", "y", "value"), ["dataset", "frame", "x", "y"], "left")
        return met.select("dataset", "frame", F.col("x0").alias("x"), F.col("y0").alias("y"), F.coalesce("value", F.lit(0.0)).alias("value"))
    rows = sampled(cube, points, ["dataset", "frame"], ["dataset", "frame", "x0", "y0"])
    return rows.withColumnsRenamed({"x0": "x", "y0": "y"})


def _stamped(cube: DataFrame, positions: DataFrame, template: Column, template_size: int) -> DataFrame:
    """The cube with ``scale`` times the template added around (px, py) of each of ``positions``."""
    half = (template_size - 1) / 2
    stamp = positions.select("dataset", "frame", "px", "py", "scale", F.explode(template).alias("t"))
    stamp = stamp.select("dataset", "frame", F.explode(_cells(F.col("px") - half + F.col("t.tx"), F.col("py") - half + F.col("t.ty"), F.col("t.tv") * F.col("scale"))).alias("c"))
    added = stamp.groupBy("dataset", "frame", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.v").alias("added"))
    out = cube.join(added, ["dataset", "frame", "x", "y"], "left").withColumn("value", F.col("value") + F.coalesce("added", F.lit(0.0)))
    return out.drop("added")


def injected(cube: DataFrame, frames: DataFrame, template: Column, template_size: int, separation: float, angle_deg: float, magnitude: float, size_x: int, size_y: int, dit_ratio: float = 1.0, extra: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The cube with a scaled template added at the position of each frame, and those positions.

    With ``extra`` = -1 a known source is taken out.
    """
    scale = flux_ratio(F.lit(float(magnitude))) * dit_ratio * extra
    positions = source_positions(frames.select("dataset", "frame", "parang"), F.lit(float(separation)), F.lit(float(angle_deg)), size_x, size_y)
    return _stamped(cube, positions.withColumn("scale", scale), template, template_size), positions


def source_positions(frames: DataFrame, separation: Column, angle_deg: Column, size_x: int, size_y: int) -> DataFrame:
    """(dataset, frame, px, py) of a source that moves with the angles."""
    phi = F.radians(angle_deg + 90 - F.col("parang"))
    return frames.withColumn("px", separation * F.cos(phi) + center(size_x)).withColumn("py", separation * F.sin(phi) + center(size_y)).drop("parang", "separation", "position_angle")


def without_sources(cube: DataFrame, frames: DataFrame, template: Column, template_size: int, targets: DataFrame, metadata: DataFrame, size_x: int, size_y: int) -> DataFrame:
    """The cube with all known sources of each dataset taken out, however many there are.

    ``targets`` (dataset, name, separation in arcsec, position_angle, contrast), ``metadata`` one row per dataset. A source is the
    template at its contrast, scaled by the integration times and the filter.
    """
    t = targets.join(metadata, "dataset").select("dataset", (F.col("separation") / F.col("pixscale")).alias("separation"), "position_angle",
        (-flux_ratio(F.col("contrast")) * F.col("dit_stack") / F.col("dit_psf_template") / F.col("nd_filter")).alias("scale"))
    moving = frames.select("dataset", "frame", "parang").join(t, "dataset")
    return _stamped(cube, source_positions(moving, F.col("separation"), F.col("position_angle"), size_x, size_y), template, template_size)


def expected_series(targets: DataFrame, frames: DataFrame, template, sigma: float, size_x: int, size_y: int) -> DataFrame:
    """Signal over time that (tx, ty, signal_time) would see of a source passing it: the template's profile at the
    distance to the source's path, over its largest value.

    The profile is that of a circular Gaussian of ``sigma`` cut at the template's edge ``template``. A
    path that leaves the frame gives NULL at those frames.
    """
    at = frames.select("dataset", F.col("frame").alias("signal_time"), F.col("parang").alias("a0"))
    cx, cy = center(size_x), center(size_y)
    rows = targets.join(at, ["dataset", "signal_time"]).join(frames.select("dataset", "frame", "parang"), "dataset")
    sx, sy = rotated(F.col("tx"), F.col("ty"), cx, cy, F.col("parang") - F.col("a0"))
    rows = rows.select("dataset", "tx", "ty", "signal_time", "frame", sx.alias("sx"), sy.alias("sy"))
    d2 = F.pow(F.col("sx") - F.col("tx"), 2) + F.pow(F.col("sy") - F.col("ty"), 2)
    edge = (F.abs(F.col("sx") - F.col("tx")) <= template) & (F.abs(F.col("sy") - F.col("ty")) <= template)
    inside = F.col("sx").between(0, size_x - 1) & F.col("sy").between(0, size_y - 1)
    value = F.when(inside, F.when(edge, F.exp(-d2 / (2 * sigma * sigma))).otherwise(F.lit(0.0)))
    top = F.max(value).over(Window.partitionBy("dataset", "tx", "ty", "signal_time"))
    return rows.select("dataset", "tx", "ty", "signal_time", "frame", F.try_divide(value, top).alias("expected"))


def in_blocks(rows: DataFrame, blocks: DataFrame, index: str, key: str, width: int) -> DataFrame:
    """The block [start, end) of each index; blocks are listed under every tile of ``width`` they touch, so it is an equi-join."""
    b = blocks.filter("end > start").withColumn("_t", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    r = rows.withColumn("_t", F.floor(F.col(index) / width))
    return r.join(b, [key, "_t"]).filter((F.col(index) >= F.col("start")) & (F.col(index) < F.col("end"))).drop("_t")


def matched_headers(headers: DataFrame, wanted: DataFrame, first: str, second: str) -> DataFrame:
    """Headers whose ``first`` name is wanted; where no name of a dataset is, those whose ``second`` is."""
    by_first = headers.join(wanted.select("dataset", F.col("name").alias(first)), ["dataset", first], "left_semi").select(*headers.columns)
    rest = headers.join(by_first.select("dataset").distinct(), "dataset", "left_anti")
    by_second = rest.join(wanted.select("dataset", F.col("name").alias(second)), ["dataset", second], "left_semi").select(*headers.columns)
    return by_first.unionByName(by_second)


def valid_at(rows: DataFrame, dimension: DataFrame, key: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the dimension row valid at their time (valid_from < ts <= valid_to, open ends NULL), and rows of unknown keys."""
    met = rows.join(dimension, key).filter((F.col("valid_from").isNull() | (F.col(ts) > F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col(ts) <= F.col("valid_to"))))
    return met, rows.join(dimension.select(key).distinct(), key, "left_anti")


def aperture_weight(dx: Column, dy: Column, radius: float, steps: int = 10) -> Column:
    """Share of a pixel inside a circle, by ``steps`` x ``steps`` sub-pixels; offsets are pixel minus centre."""
    sub = F.transform(F.sequence(F.lit(0), F.lit(steps * steps - 1)), lambda k: F.when(
        F.pow(dx - 0.5 + (F.floor(k / steps) + 0.5) / steps, 2) + F.pow(dy - 0.5 + (k % steps + 0.5) / steps, 2) <= radius * radius, 1.0).otherwise(0.0))
    return F.aggregate(sub, F.lit(0.0), lambda s, v: s + v) / (steps * steps)


def ring_positions(targets: DataFrame, radius: float, exclusion_deg: float | None = None) -> DataFrame:
    """Reference positions on the ring of each (sep, angle in degrees): evenly spaced apertures, the target's surroundings left out."""
    ratio = F.lit(radius) / F.col("sep")
    opening = F.degrees(2 * F.asin(ratio))
    opening = F.when(ratio <= 1, opening).otherwise(F.raise_error(F.lit("too close to the centre")).cast("double"))
    rows = targets.withColumn("opening", opening)
    excluded = F.lit(exclusion_deg) if exclusion_deg is not None else 3 * F.col("opening")
    rows = rows.withColumn("excluded", F.greatest(excluded, F.col("opening")))
    rows = rows.withColumn("arc", 360 - F.col("excluded") - F.col("opening"))
    rows = rows.withColumn("n", (F.floor(F.round(F.col("arc") / F.col("opening"), 1)) + 1).cast("int")).filter("n > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    step = F.coalesce(F.try_divide(F.col("arc"), F.col("n") - 1), F.lit(0.0))
    return rows.withColumn("step", step).withColumn("ref_angle", F.col("angle") + (F.col("excluded") + F.col("opening")) / 2 + F.col("i") * step).drop("excluded", "arc")


def ring_rotations(rings: DataFrame, steps: int) -> DataFrame:
    """``rotation`` 0 is the ring itself; further ones are turned by parts of a step and lack the last position."""
    rows = rings.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    rows = rows.filter((F.col("rotation") == 0) | (F.col("i") < F.col("n") - 1))
    return rows.withColumn("ref_angle", F.col("ref_angle") + F.col("rotation") * F.col("step") / (steps + 1))


def polar_points(maps: DataFrame, keys: list[str], grid: int, size_x: int, size_y: int) -> DataFrame:
    """(keys, r, p, px, py): the points of a polar grid around the centre of each map."""
    reach = min(size_x, size_y) / 2
    ids = maps.select(*keys).distinct()
    rows = ids.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    radius, phi = F.col("r") * (reach / grid), F.col("p") * (2 * math.pi / grid)
    return rows.withColumn("px", center(size_x) + radius * F.cos(phi)).withColumn("py", center(size_y) + radius * F.sin(phi))


def template_match(polar: DataFrame, template: DataFrame, grid: int, keys: list[str]) -> DataFrame:
    """Normalised correlation of a small template (dr, dp, t) with each place of polar maps (keys, r, p, value); p wraps around.

    Map cells are sent to the places whose window they fall in; sums per place give means, norms and the product.
    """
    moments = template.agg(F.count("*").alias("m"), F.avg("t").alias("tm"), F.sqrt(F.sum(F.col("t") * F.col("t")) - F.count("*") * F.pow(F.avg("t"), 2)).alias("tn")).first()
    cells = F.array(*[F.struct(F.lit(int(r["dr"])).alias("dr"), F.lit(int(r["dp"])).alias("dp"), F.lit(float(r["t"])).alias("t")) for r in template.collect()])  # a stamp of a few dozen cells
    sent = polar.select(*keys, "r", "p", "value", F.explode(cells).alias("c"))
    sent = sent.select(*keys, (F.col("r") - F.col("c.dr")).alias("r"), F.pmod(F.col("p") - F.col("c.dp"), F.lit(grid)).alias("p"), "value", F.col("c.t").alias("t"))
    sums = sent.filter(F.col("r").between(0, grid - 1)).groupBy(*keys, "r", "p").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.sum(F.col("value") * F.col("t")).alias("st"))
    m = float(moments["m"])
    spread = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / m, F.lit(0.0)))
    score = F.try_divide(F.col("st") - F.col("s") * float(moments["tm"]), F.when(spread > 0, spread * float(moments["tn"])))
    return sums.select(*keys, "r", "p", F.coalesce(score, F.lit(0.0)).alias("value"))


def arc_cells(positions: DataFrame, rotation: float, keys: list[str], size_x: int, size_y: int, template: Column, template_size: int) -> DataFrame:
    """Sum of templates stamped at 2 * int(rotation) points of the arc of ``rotation`` degrees around each (keys, sep, angle in degrees)."""
    n = max(2 * int(rotation), 1)
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = positions.withColumn("k", steps).withColumn("a", F.radians(F.col("angle") - rotation / 2 + F.col("k") * (rotation / max(n - 1, 1))))
    half = (template_size - 1) / 2
    px, py = center(size_x) + F.col("sep") * F.cos("a"), center(size_y) + F.col("sep") * F.sin("a")
    stamp = rows.select(*keys, px.alias("px"), py.alias("py"), F.explode(template).alias("t"))
    cells = stamp.select(*keys, F.explode(_cells(F.col("px") - half + F.col("t.tx"), F.col("py") - half + F.col("t.ty"), F.col("t.tv"))).alias("c"))
    inside = F.col("c.x").between(0, size_x - 1) & F.col("c.y").between(0, size_y - 1)
    return cells.filter(inside).groupBy(*keys, F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.v").alias("value"))


def patches(cube: DataFrame, positions: DataFrame, half: int) -> DataFrame:
    """(dataset, frame, dx, dy, value): bilinear windows around the moving position (px, py) of each frame."""
    offsets = F.sequence(F.lit(-half), F.lit(half))
    p = positions.withColumn("dx", F.explode(offsets)).withColumn("dy", F.explode(offsets))
    p = p.select("dataset", "frame", "dx", "dy", (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"))
    return sampled(cube, p, ["dataset", "frame"], ["dataset", "frame", "dx", "dy"])
