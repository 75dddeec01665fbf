"""Temporal binning, correlations, folds, integrals and other work along the time axis."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.scans import running_areas


def binned(df: DataFrame, k: int, keys: list[str], value: str = "value", how: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Blocks of ``k`` frames, a short last one kept; ``how`` combines them."""
    return df.groupBy(*keys, F.floor(F.col("frame") / k).cast("int").alias("frame")).agg(how(F.col(value)).alias(value))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL where a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when((sx > 0) & (sy > 0), sx * sy))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity as an aggregate: 0 if a side is zero."""
    norm = F.sqrt(F.sum(a * a) * F.sum(b * b))
    return F.coalesce(F.try_divide(F.sum(a * b), F.when(norm > 0, norm)), F.lit(0.0))


def admissible_covariates(expected: DataFrame, obscon: DataFrame, most: float = 0.5) -> DataFrame:
    """(x, y, signal_time, key) of the covariates that may serve as predictors: those not too much like the expected signal.

    All of them where the expected signal has a missing value or does not vary; a covariate that does not vary is out elsewhere.
    """
    o = obscon.select("frame", "key", F.col("value").alias("_o"))
    e = F.col("expected")
    g = expected.join(o, "frame").groupBy("x", "y", "signal_time", "key").agg(F.max(e.isNull()).alias("_gap"), F.min(e).alias("_low"), F.max(e).alias("_high"), pearson(e, F.col("_o")).alias("r"))
    return g.filter(F.col("_gap") | (F.col("_low") == F.col("_high")) | (F.abs("r") <= most)).select("x", "y", "signal_time", "key", "r")


#: Pairs of pixels in a batch of results, and the least number of blocks of pixels.
_PAIRS, _BLOCKS = 1 << 18, 16


def correlation_map(series: DataFrame, block: int = 8192, epsilon: float = 2.220446049250313e-16) -> DataFrame:
    """Correlation over time of every two pixels (x, y) <= (x2, y2), from (x, y, v).

    Pixels go to _BLOCKS blocks by hash, or more of about ``block``; each pair of blocks is one group, whose matrix product is taken and sent tile
    by tile. A series is shuffled once per block: of N pixels N * N / ``block`` series, a small part of the N * N / 2 results. Large maps have a task for
    each group. Pairs come in runs of one pixel, the other in order, and a group's first tile in order of abs(value). So the result is small where it is
    written as Parquet: pixels repeat, and values get a dictionary, which a writer keeps only if its first 20,000 rows repeat enough.
    """
    rows = series.select("x", "y", "v")
    count = rows.count()
    n = max(_BLOCKS, -(-count // block))
    parts = min(n * (n + 1) // 2, max(_BLOCKS, count * count >> 23))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("x", "y"), F.lit(n)))
    left = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = left.select(F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "x", "y", "v")
    pairs = pairs.withColumn("k", F.pmod(F.shiftright(F.col("j") * (F.col("j") + 1), 1) + F.col("i"), F.lit(parts)).cast("int"))

    def product(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        i, j = (k.as_py() for k in key[:2])
        own, x, y = (t[c].to_numpy() for c in ("b", "x", "y"))
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
        d = v - v.mean(1, keepdims=True)
        s = (d**2).sum(1)
        order, first = np.lexsort((y, x)), True
        one, two = order[own[order] == i], order[own[order] == j]
        side = math.isqrt(_PAIRS)
        for lo, low in itertools.product(range(0, len(one), side), range(0, len(two), side)):
            at, by = one[lo : lo + side], two[low : low + side]
            c = np.clip(d[at] @ d[by].T / (np.sqrt(np.outer(s[at], s[by])) + epsilon), -1, 1)
            x1, y1, x2, y2 = x[at], y[at], x[by], y[by]
            swap = (x1[:, None] > x2) | ((x1[:, None] == x2) & (y1[:, None] > y2))
            a, b = np.nonzero(~swap)
            halves = [(x1[a], y1[a], x2[b], y2[b], c[a, b])]
            if i != j:
                b, a = np.nonzero(swap.T)
                halves.append((x2[b], y2[b], x1[a], y1[a], c[a, b]))
            for columns in halves:
                if len(columns[-1]):
                    if first:
                        rising, first = np.argsort(np.abs(columns[-1])), False
                        columns = [k[rising] for k in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(k) for k in columns], ["x", "y", "x2", "y2", "value"])

    return pairs.repartitionById(parts, "k").groupBy("i", "j", "k").applyInArrow(product, "x int, y int, x2 int, y2 int, value double")


def correlation_matrix(obscon: DataFrame) -> DataFrame:
    """Correlation of every two covariates over the frames."""
    other = obscon.select("dataset", "frame", F.col("key").alias("key2"), F.col("value").alias("value2"))
    return obscon.join(other, ["dataset", "frame"]).groupBy("dataset", "key", "key2").agg(pearson(F.col("value"), F.col("value2")).alias("value"))


def selected(obscon: DataFrame, keys: list[str] | str | None) -> DataFrame:
    """None or [] selects nothing, 'all' everything; a listed key must exist."""
    if not keys:
        return obscon.limit(0)
    if keys == "all":
        return obscon
    there = {r["key"] for r in obscon.select("key").distinct().collect()}  # names of covariates: a handful
    if lost := set(keys) - there:
        raise KeyError(f"no such covariates: {sorted(lost)}")
    return obscon.filter(F.col("key").isin(list(keys)))


def wide(obscon: DataFrame, keys: list[str]) -> DataFrame:
    return obscon.groupBy("dataset", "frame").pivot("key", keys).agg(F.first("value"))


def standardised(df: DataFrame, keys: list[str], value: str = "value", train: Column | None = None) -> DataFrame:
    """Minus the mean, over the population deviation (0 counts as 1) of the rows that ``train`` marks."""
    w = Window.partitionBy(*keys)
    own = F.col(value) if train is None else F.when(train, F.col(value))
    sd = F.stddev_pop(own).over(w)
    return df.withColumn("scaled", (F.col(value) - F.avg(own).over(w)) / F.when(sd == 0, 1.0).otherwise(sd))


def over_largest(value: Column, keys: list[str], absolute: bool = False) -> Column:
    """Divided by the largest (absolute) value of the group."""
    top = F.max(F.abs(value) if absolute else value).over(Window.partitionBy(*keys))
    return F.try_divide(value, top)


def first_peak() -> tuple[Column, Column]:
    """Largest value and the first frame that has it, as aggregates over (frame, value)."""
    best = F.max(F.struct(F.col("value"), (-F.col("frame")).alias("f")))
    return best["value"], -best["f"]


def fold_of(frame: Column, n: int) -> Column:
    """Alternating folds; the train rows of fold i are those of other folds (all rows if n is 1)."""
    return F.pmod(frame, F.lit(n)).cast("int")


def signal_times(cube: DataFrame, k: int) -> DataFrame:
    """(dataset, signal_time): ``k`` frames spread over the whole range."""
    last = cube.groupBy("dataset").agg(F.max("frame").alias("last"))
    if k < 1:
        return last.select("dataset", F.lit(0).alias("signal_time")).limit(0)
    step = F.lit(0.0) if k == 1 else F.col("last") / F.lit(float(k - 1))
    each = last.select("dataset", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    return each.select("dataset", F.floor(F.col("i") * F.col("step") + 1e-9).cast("int").alias("signal_time"))


def running_integral(readings: DataFrame, width: float = 86400.0) -> DataFrame:
    """``integral``: sum over earlier readings of value times the seconds until the next one; missing readings are dropped. Tiles of ``width`` seconds are summed first."""
    rows = readings.filter("value is not null").withColumn("t", F.unix_micros("ts") / 1e6)
    return running_areas(rows, "parameter", "t", "value", width)


def block_offsets(blocks: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """start and end of each block in the rows before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("end", F.sum(size).over(w)).withColumn("start", F.col("end") - F.col(size))


def spread(blocks: DataFrame, size: str, first: str, last: str, name: str = "value") -> DataFrame:
    """Rows ``i`` of each block with values in equal steps from ``first`` to ``last``."""
    each = blocks.filter(F.col(size) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col(size) - 1).cast("int"))))
    step = F.try_divide(F.col(last) - F.col(first), F.col(size) - 1)
    return each.withColumn(name, F.col(first) + F.col("i") * F.coalesce(step, F.lit(0.0)))


def field_rotation(frames: DataFrame) -> DataFrame:
    """Degrees between first and last angle; wraps are undone once, and a turn of 180 or more is an error."""
    ends = frames.groupBy("dataset").agg(F.min_by("parang", "frame").alias("a"), F.max_by("parang", "frame").alias("b"))
    plain = F.abs(F.col("b") - F.col("a"))
    wrapped = F.abs(F.pmod(F.col("b") + 360, F.lit(360.0)) - F.pmod(F.col("a") + 360, F.lit(360.0)))
    error = F.raise_error(F.lit("field rotation is 180 degrees or more")).cast("double")
    return ends.select("dataset", F.when(plain < 180, plain).when(wrapped < 180, wrapped).otherwise(error).alias("rotation"))


def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial results in one table; each cell has a value in at most one part."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("value").alias("n_parts"))
