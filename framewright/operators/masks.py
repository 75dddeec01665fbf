"""Crops, pads and masks as predicates over pixel coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.coords import center
from framewright.operators.scans import numbered


def crop_start(old: int, new: int) -> int:
    return old // 2 - new // 2


def cropped(cube: DataFrame, sizes: dict[str, int], wanted: dict[str, int]) -> DataFrame:
    """The central part; an axis stays if -1 or more than there is is wanted. Coordinates start at 0 again."""
    for axis, new in wanted.items():
        if 0 < new <= sizes[axis]:
            at = crop_start(sizes[axis], new)
            cube = cube.filter(F.col(axis).between(at, at + new - 1)).withColumn(axis, (F.col(axis) - at).cast("int"))
    return cube


def padded(frame: DataFrame, sizes: dict[str, int], wanted: dict[str, int], keys: list[str], value: float = 0.0) -> DataFrame:
    """Cells around each map; the left side gets half of the difference."""
    if any(wanted[a] < sizes[a] for a in wanted):
        raise ValueError("the target shape is smaller than the input")
    for axis, new in wanted.items():
        frame = frame.withColumn(axis, F.col(axis) + (new - sizes[axis]) // 2)
    grid = frame.select(*keys).distinct()
    for axis, new in wanted.items():
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(new - 1))))
    cells = grid.join(frame, [*keys, *wanted], "left")
    return cells.withColumn("value", F.coalesce("value", F.lit(value)))


def crop_or_pad(frame: DataFrame, sizes: dict[str, int], wanted: dict[str, int], keys: list[str]) -> DataFrame:
    if all(wanted[a] <= sizes[a] for a in wanted):
        return cropped(frame, sizes, wanted)
    if all(wanted[a] >= sizes[a] for a in wanted):
        return padded(frame, sizes, wanted, keys)
    raise ValueError("cannot crop one axis and pad the other")


def _c(x) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else x


def circle(x: Column, y: Column, cx, cy, radius) -> Column:
    """Strictly inside."""
    dx, dy, r = x - _c(cx), y - _c(cy), _c(radius)
    return dx * dx + dy * dy < r * r


def annulus(x: Column, y: Column, cx, cy, inner, outer) -> Column:
    return circle(x, y, cx, cy, inner) != circle(x, y, cx, cy, outer)


def roi(size_x, size_y, inner, outer) -> Column:
    """The annulus around the frame's centre, over columns x and y."""
    return annulus(F.col("x"), F.col("y"), center(size_x), center(size_y), inner, outer)


def predictor(x: Column, y: Column, tx: Column, ty: Column, size_x: int, size_y: int, r_target, r_opposite, r_excluded) -> Column:
    """Near the target or near its mirror image, but not too near the target."""
    near = circle(x, y, tx, ty, r_target)
    opposite = circle(x, y, F.lit(size_x - 1) - tx, F.lit(size_y - 1) - ty, r_opposite)
    return (near | opposite) & ~circle(x, y, tx, ty, r_excluded)


def split_of(pixels: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Every n-th position of each map in order of (x, y) goes to the same split; columns of pixels are counted first."""
    rows = numbered(pixels, list(keys or []), ["x", "y"], F.col("x"), "split")
    return rows.withColumn("split", (F.col("split") % n).cast("int")).drop("_n")


def zero_outside(value: Column, x: Column, y: Column, cx, cy, radius) -> Column:
    return F.when(circle(x, y, cx, cy, radius), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def null_outside(value: Column, inside: Column) -> Column:
    return F.when(inside, value)


def radial_weight(r: Column, grid: int, size: int, zero_radius: float = 4.0) -> Column:
    """1e-8 up to the inner radius, then rising to 1 at the edge of a polar grid."""
    zero = int(2 * zero_radius / size * grid)
    rising = F.lit(1e-8) + (r - zero) * ((1 - 1e-8) / max(grid - zero - 1, 1))
    return F.when(r < zero, F.lit(1e-8)).otherwise(rising)


def without_weaker_neighbours(blobs: DataFrame, key: str = "map_id", reach: float = 8.0) -> DataFrame:
    """Drop a candidate if a strictly brighter one of its map lies within ``reach`` radially.

    Candidates are dealt to radial tiles of that width, so only neighbouring tiles meet.
    """
    tile = F.floor(F.col("r") / reach)
    mine = blobs.withColumn("_tile", tile)
    other = blobs.select(F.col(key).alias("_k"), F.col("r").alias("_r"), F.col("brightness").alias("_b"), F.explode(F.array(tile - 1, tile, tile + 1)).alias("_t"))
    near = (F.col(key) == F.col("_k")) & (F.col("_tile") == F.col("_t")) & (F.abs(F.col("r") - F.col("_r")) <= reach) & (F.col("_b") > F.col("brightness"))
    return mine.join(other, near, "left_anti").drop("_tile")


def components(mask: DataFrame, written, key: str = "map_id") -> DataFrame:
    """(map, x, y, label) of 4-connected components of mask cells: the least (x, y) of each.

    Labels spread to neighbours and then jump along labels; each round is written by ``written``. Its joins are by sort and merge: files of
    labels are small for the rows in them, and a broadcast would take them all through the driver in every round.
    """
    cell = F.struct("x", "y")
    labels = written(mask.select(key, "x", "y", cell.alias("label")))
    while True:
        steps = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
        sent = labels.select(key, F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in steps])).alias("to"), "label")
        least = sent.groupBy(key, F.col("to.x").alias("x"), F.col("to.y").alias("y")).agg(F.min("label").alias("near"))
        spread = labels.join(least.hint("merge"), [key, "x", "y"]).select(key, "x", "y", "label", "near")
        root = spread.select(F.col(key), F.struct("x", "y").alias("near"), F.col("near").alias("far"))
        new = spread.join(root.hint("merge"), [key, "near"]).select(key, "x", "y", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("label")).alias("moved"))
        new = written(new)
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        labels = new.drop("moved")


def without_components(mask: DataFrame, written, least: int = 1, most: int | None = None, key: str = "map_id") -> DataFrame:
    """Mask cells of components of ``least`` to ``most`` cells."""
    labelled = components(mask, written, key)
    sizes = labelled.groupBy(key, "label").agg(F.count("*").alias("n"))
    ok = F.col("n") >= least if most is None else F.col("n").between(least, most)
    return labelled.join(sizes.filter(ok).hint("merge"), [key, "label"], "left_semi").select(key, "x", "y")


def union(masks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, masks).distinct()
