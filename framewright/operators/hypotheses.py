"""Match of whole source paths with residuals keyed by signal time, and the signal estimate chosen by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.coords import center, rotated
from framewright.operators.evaluate import residual_pick
from framewright.operators.joins import near_pairs, nearest
from framewright.operators.resample import template_value


def overlay_cells(hypotheses: DataFrame, frames: DataFrame, pixels: DataFrame, template: Column, template_size: int, size_x: int, size_y: int) -> DataFrame:
    """(dataset, hx, hy, signal_time, frame, x, y, value): what a source that is at (hx, hy) at its signal time leaves in each pixel near its path,
    over the largest value of the whole path. Pixels the template does not reach have no row: they hold nothing.

    ``template`` is an array of ``template_size`` squared values.
    """
    at = frames.select("dataset", F.col("frame").alias("signal_time"), F.col("parang").alias("a0"))
    path = hypotheses.select("dataset", "hx", "hy", "signal_time").join(at, ["dataset", "signal_time"]).join(frames.select("dataset", "frame", "parang"), "dataset")
    px, py = rotated(F.col("hx"), F.col("hy"), center(size_x), center(size_y), F.col("parang") - F.col("a0"))
    path = path.select("dataset", "hx", "hy", "signal_time", "frame", px.alias("tx"), py.alias("ty"))
    half = (template_size - 1) / 2
    near = near_pairs(path, pixels.select("dataset", "x", "y"), (half + 1) * 2**0.5, ["dataset"])
    value = template_value(template, F.col("x") - F.col("tx") + half, F.col("y") - F.col("ty") + half, template_size, template_size)
    cells = near.select("dataset", "hx", "hy", "signal_time", "frame", "x", "y", value.alias("value")).filter("value > 0")
    top = F.max("value").over(Window.partitionBy("dataset", "hx", "hy", "signal_time"))
    return cells.withColumn("value", F.col("value") / top)


def affected(cells: DataFrame, trained: DataFrame, frames: DataFrame, least: float = 0.5) -> DataFrame:
    """(dataset, hx, hy, signal_time, x, y, peak, trained_time) of the pixels that a path reaches with at least ``least``: the first frame of their
    peak, and the nearest signal time (dataset, signal_time of ``trained``) for which there are residuals, the lower one on ties."""
    best = F.max(F.struct(F.round("value", 9).alias("v"), (-F.col("frame")).alias("f"), F.col("value").alias("raw")))
    peak = cells.groupBy("dataset", "hx", "hy", "signal_time", "x", "y").agg(best.alias("b"))
    peak = peak.filter(F.col("b.raw") >= least).select("dataset", "hx", "hy", "signal_time", "x", "y", (-F.col("b.f")).cast("int").alias("peak"))
    grid = trained.select("dataset", F.col("signal_time").alias("trained_time")).distinct()
    close = nearest(frames.select("dataset", F.col("frame").alias("peak")).distinct(), grid, "peak", "trained_time", ["dataset"])
    return peak.join(close.select("dataset", "peak", F.col("trained_time").cast("int").alias("trained_time")), ["dataset", "peak"])


def path_matches(cells: DataFrame, pixels: DataFrame, residuals: DataFrame) -> DataFrame:
    """(dataset, hx, hy, signal_time, mean, median, n) of the cosine similarities between the expected series of the affected pixels (``affected``) and
    their residuals (dataset, signal_time, frame, x, y, value) at their trained times.

    The hypothesis's own pixel does not count, nor one without a whole residual; a hypothesis without any has no row.
    """
    keys = ["dataset", "hx", "hy", "signal_time", "x", "y"]
    others = pixels.filter("not (hx = x and hy = y)")
    r = residuals.select("dataset", F.col("signal_time").alias("trained_time"), "x", "y", "frame", F.col("value").alias("r"))
    norms = r.groupBy("dataset", "trained_time", "x", "y").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.min(F.col("r").isNotNull()).alias("whole")).filter("whole")
    met = cells.join(others.select(*keys, "trained_time"), keys).join(r, ["dataset", "trained_time", "x", "y", "frame"], "left")
    sums = met.groupBy(*keys, "trained_time").agg(F.sum(F.col("value") * F.col("r")).alias("er"), F.sum(F.col("value") * F.col("value")).alias("ee"))
    s = sums.join(norms, ["dataset", "trained_time", "x", "y"])
    similarity = F.coalesce(F.try_divide("er", F.when(F.col("rr") * F.col("ee") > 0, F.sqrt(F.col("rr") * F.col("ee")))), F.lit(0.0))
    return s.withColumn("s", similarity).groupBy("dataset", "hx", "hy", "signal_time").agg(F.avg("s").alias("mean"), F.median("s").alias("median"), F.count("*").alias("n"))


def signal_residuals(default: DataFrame, residuals: DataFrame, matches: DataFrame, least: float) -> DataFrame:
    """One residual per pixel: that of its hypothesis's signal time where the mean match is at least ``least``, the default one elsewhere."""
    chosen = matches.select(F.col("hx").alias("x"), F.col("hy").alias("y"), "signal_time", (F.col("mean") >= least).alias("selected"))
    return residual_pick(default, residuals, chosen)
