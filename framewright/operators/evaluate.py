"""Hypotheses, match fractions, photometry, t-tests and detection limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framewright.functions.coords import flux_ratio, magnitudes, polar_to_cartesian
from framewright.operators.joins import aperture_weight, near_pairs, ring_positions, ring_rotations
from framewright.operators.series import cosine


def best_hypothesis(residuals: DataFrame, expected: DataFrame, least: float = 0.0) -> DataFrame:
    """(x, y, signal_time, similarity) of the signal time whose expected series is most like its residual.

    Similarity is clipped to [0, 1] and rounded to 3 places, half to even; series with a missing value do not count; the
    earliest of equal signal times wins; no signal time where none is above ``least``.
    """
    met = residuals.join(expected, ["x", "y", "signal_time", "frame"])
    both = F.col("value").isNotNull() & F.col("expected").isNotNull()
    s = met.groupBy("x", "y", "signal_time").agg(cosine(F.col("value"), F.col("expected")).alias("s"), F.min(both).alias("whole"))
    s = s.withColumn("s", F.when(F.col("whole"), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s")), 3)))
    best = s.groupBy("x", "y").agg(F.max(F.when(F.col("s").isNotNull(), F.struct("s", (-F.col("signal_time")).alias("t")))).alias("b"))
    found = F.col("b.s") > least
    return best.select("x", "y", F.when(found, -F.col("b.t")).cast("int").alias("signal_time"), F.when(found, F.col("b.s")).otherwise(F.lit(0.0) if least < 0 else F.col("b.s")).alias("similarity"))


def residual_pick(default: DataFrame, residuals: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """The default residual, or that of the pixel's own signal time where the pixel is selected and has one."""
    h = hypotheses.select("x", "y", "signal_time", "selected")
    r = residuals.select("x", "y", "signal_time", "frame", F.col("value").alias("other"))
    rows = default.join(h, ["x", "y"], "left").join(r, ["x", "y", "frame", "signal_time"], "left")
    use = F.coalesce("selected", F.lit(False)) & F.col("signal_time").isNotNull()
    return rows.select("x", "y", "frame", F.when(use, F.col("other")).otherwise(F.col("value")).alias("value"))


def match_fractions(affected: DataFrame) -> DataFrame:
    """Mean and median similarity over the affected pixels of each target, from (tx, ty, x, y, frame, value, expected).

    The target itself does not count, nor pixels with a missing residual.
    """
    rows = affected.filter("not (tx = x and ty = y)")
    s = rows.groupBy("tx", "ty", "x", "y").agg(cosine(F.col("value"), F.col("expected")).alias("s"), F.min(F.col("value").isNotNull()).alias("whole")).filter("whole")
    return s.groupBy("tx", "ty").agg(F.avg("s").alias("mean"), F.median("s").alias("median"))


def aperture_sums(maps: DataFrame, positions: DataFrame, radius: float, keys: list[str], by: list[str]) -> DataFrame:
    """Flux in a circle at (px, py): pixels by their share inside it, met through tiles."""
    reach = radius + 1.0
    t = positions.withColumnsRenamed({"px": "tx", "py": "ty"})
    near = near_pairs(t, maps.select(*keys, "x", "y", "value"), reach, keys)
    w = aperture_weight(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"), radius)
    return near.groupBy(*by).agg(F.sum(w * F.coalesce("value", F.lit(0.0))).alias("flux"))


def brightest_offset(maps: DataFrame, positions: DataFrame, radius: float, search: float, keys: list[str], by: list[str], steps: int = 21) -> DataFrame:
    """The best of ``steps`` x ``steps`` apertures around each position; the first in grid order on ties."""
    offset = lambda k: -search + k * (2 * search / (steps - 1))
    grid = positions.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps * steps - 1))))
    grid = grid.withColumn("px", F.col("px") + offset(F.col("k") % steps)).withColumn("py", F.col("py") + offset(F.floor(F.col("k") / steps)))
    flux = aperture_sums(maps, grid, radius, keys, [*by, "k"]).join(grid.select(*by, "k", "px", "py"), [*by, "k"])
    best = flux.groupBy(*by).agg(F.max(F.struct(F.round("flux", 12).alias("flux"), (-F.col("k")).alias("o"), "px", "py")).alias("b"))
    return best.select(*by, "b.flux", "b.px", "b.py")


def _ibeta_tail(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, for x below the mean."""
    tiny = 1e-300
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - np.log(a) - np.vectorize(math.lgamma, otypes=[float])(a) - math.lgamma(b) + np.vectorize(math.lgamma, otypes=[float])(a + b))
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return front * h


def t_survival(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's distribution, exact far into the tail."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    a, x = df[ok] / 2, df[ok] / (df[ok] + t[ok] ** 2)
    far = x < (a + 1) / (a + 2.5)
    half = np.empty(len(x))
    half[far] = _ibeta_tail(a[far], 0.5, np.maximum(x[far], 1e-300)) / 2
    y = t[ok][~far] ** 2 / (df[ok][~far] + t[ok][~far] ** 2)
    half[~far] = 0.5 - np.array([_ibeta_swapped(v, w) for v, w in zip(a[~far], y)]) / 2
    out[ok] = np.where(t[ok] >= 0, half, 1 - half)
    return out


def _ibeta_swapped(a: float, y: float) -> float:
    """I_y(1/2, a)."""
    if y <= 0:
        return 0.0
    return float(_ibeta_tail(np.array([0.5]), a, np.array([y]))[0])


@F.pandas_udf(DoubleType())
def false_positive_fraction(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_survival(t.to_numpy(float), df.to_numpy(float)))


def t_test(samples: DataFrame, keys: list[str], is_signal: Column, value: str = "value") -> DataFrame:
    """Two-sample statistic of the signal against the noise samples of each group; too few samples are an error."""
    one, two = F.when(is_signal, F.col(value)), F.when(~is_signal, F.col(value))
    g = samples.groupBy(*keys).agg(F.avg(one).alias("m1"), F.count(one).alias("n1"), F.avg(two).alias("m2"), F.stddev_samp(two).alias("sd"), F.count(two).alias("n2"))
    ok = (F.col("n1") >= 1) & (F.col("n2") >= 2)
    signal = F.when(ok, F.col("m1") - F.col("m2")).otherwise(F.raise_error(F.lit("too few samples")).cast("double"))
    g = g.withColumn("signal", signal).withColumn("noise", F.col("sd") * F.sqrt(1 / F.col("n1") + 1 / F.col("n2")))
    g = g.withColumn("snr", F.try_divide("signal", "noise")).withColumn("df", F.col("n1") + F.col("n2") - 2)
    return g.select(*keys, "signal", "noise", "snr", "df")


def with_fpf(tests: DataFrame) -> DataFrame:
    rows = tests.withColumn("fpf", false_positive_fraction(F.col("snr"), F.col("df").cast("double")))
    return rows.withColumn("p_value", false_positive_fraction(-F.col("snr"), F.col("df").cast("double"))).withColumn("log_fpf", -F.log10(F.when(F.col("fpf") > 0, F.col("fpf"))))


def summary(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, median, population deviation, least and largest of each column."""
    how = {"mean": F.avg, "median": F.median, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in how.items()])


def target_metrics(maps: DataFrame, targets: DataFrame, cx: float, cy: float, radius: float, rotations: int = 10, noise_radius: float = 0.5, exclusion_deg: float | None = None) -> DataFrame:
    """Per (map_id, target): flux there against fluxes on its ring, for each rotation of the ring; then with_fpf and summary.

    ``targets`` (map_id, target, sep, angle in degrees).
    """
    def place(df: DataFrame, angle: str) -> DataFrame:
        px, py = polar_to_cartesian(F.col("sep"), F.radians(angle), F.lit(cx), F.lit(cy))
        return df.withColumn("px", px).withColumn("py", py)

    rings = place(ring_rotations(ring_positions(targets, radius, exclusion_deg), rotations), "ref_angle")
    noise = aperture_sums(maps, rings.select("map_id", "target", "rotation", "i", "px", "py"), noise_radius, ["map_id"], ["map_id", "target", "rotation", "i"])
    own = aperture_sums(maps, place(targets, "angle").select("map_id", "target", "px", "py"), radius, ["map_id"], ["map_id", "target"])
    own = own.join(rings.select("map_id", "target", "rotation").distinct(), ["map_id", "target"])
    samples = noise.select("map_id", "target", "rotation", F.lit(False).alias("is_signal"), "flux").unionByName(own.select("map_id", "target", "rotation", F.lit(True).alias("is_signal"), "flux"))
    return t_test(samples, ["map_id", "target", "rotation"], F.col("is_signal"), "flux")


def stellar_fluxes(templates: DataFrame, metadata: DataFrame, radius: float, size_x: int, size_y: int) -> DataFrame:
    """(dataset, stellar_flux): flux in a circle at the centre of each template, scaled to the integration time of the stack and by the filter."""
    met = templates.join(metadata, "dataset")
    scaled = met.select("dataset", "x", "y", (F.col("value") * F.col("dit_stack") / F.col("dit_psf_template") / F.col("nd_filter")).alias("value"))
    at = scaled.select("dataset").distinct().select("dataset", F.lit(size_x / 2 - 0.5).alias("px"), F.lit(size_y / 2 - 0.5).alias("py"))
    return aperture_sums(scaled, at, radius, ["dataset"], ["dataset"]).withColumnRenamed("flux", "stellar_flux")


def less_baseline(maps: DataFrame, baseline: DataFrame) -> DataFrame:
    """Maps less the map made without any source (x, y, value); missing values count as 0."""
    b = baseline.select("x", "y", F.col("value").alias("_b"))
    return maps.join(b, ["x", "y"], "left").withColumn("value", F.coalesce(F.col("value") - F.col("_b"), F.lit(0.0))).drop("_b")


def contrasts(fluxes: DataFrame) -> DataFrame:
    """Contrast and throughput from (raw_flux, background_flux, stellar_flux, expected_contrast)."""
    ratio = (F.col("raw_flux") - F.col("background_flux")) / F.col("stellar_flux")
    rows = fluxes.withColumn("observed_flux_ratio", ratio)
    observed = F.when(F.col("observed_flux_ratio") > 1e-8, magnitudes(F.col("observed_flux_ratio"))).otherwise(F.lit(float("inf")))
    expected = flux_ratio(F.col("expected_contrast"))
    return rows.withColumn("observed_contrast", observed).withColumn("throughput", F.when(F.col("expected_contrast").isNotNull(), F.greatest(F.col("observed_flux_ratio") / expected, F.lit(0.0))))


def detection_limits(results: DataFrame, sigma: float = 5.0, how=F.median, cells: int = 10_000) -> DataFrame:
    """(separation, limit): last contrast where the aggregated -log10 false positive fraction crosses that of ``sigma``.

    The crossing of the line between neighbouring contrasts, moved to the middle of its cell of an even grid; NULL without one.
    """
    threshold = -math.log10(math.erfc(sigma / math.sqrt(2)) / 2)
    g = results.groupBy("separation", "expected_contrast").agg((how(-F.log10(F.col("fpf_median"))) - threshold).alias("f"))
    span = Window.partitionBy("separation")
    w = span.orderBy("expected_contrast")
    g = g.withColumn("low", F.min("expected_contrast").over(span)).withColumn("high", F.max("expected_contrast").over(span))
    g = g.withColumn("c2", F.lead("expected_contrast").over(w)).withColumn("f2", F.lead("f").over(w))
    crosses = (F.col("f") > 0) != (F.col("f2") > 0)
    root = F.col("expected_contrast") + F.col("f") / (F.col("f") - F.col("f2")) * (F.col("c2") - F.col("expected_contrast"))
    step = (F.col("high") - F.col("low")) / cells
    middle = F.col("low") + (F.floor((root - F.col("low")) / step) + 0.5) * step
    return g.groupBy("separation").agg(F.max(F.when(crosses, middle)).alias("limit"))


def local_maxima(maps: DataFrame, key: str = "map_id") -> DataFrame:
    """Cells above all of their eight neighbours."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    sent = maps.select(key, F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in steps])).alias("to"), "value")
    around = sent.groupBy(key, F.col("to.x").alias("x"), F.col("to.y").alias("y")).agg(F.max("value").alias("around"))
    return maps.join(around, [key, "x", "y"], "left").filter("around is null or value > around").drop("around")


GAUSS_SCHEMA = "map_id int, target int, amplitude double, sigma double, px double, py double"


def gaussian_fluxes(maps: DataFrame, positions: DataFrame, radius: float = 5.0, search: float = 0.0, iterations: int = 60) -> DataFrame:
    """Circular Gaussian at each (map_id, target, px, py), by damped Gauss-Newton over the pixels within ``radius``; ``search`` > 0
    lets the centre move that far on each axis."""
    near = near_pairs(positions.withColumnsRenamed({"px": "tx", "py": "ty"}), maps.select("map_id", "x", "y", "value"), radius, ["map_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = pdf.x.to_numpy(float), pdf.y.to_numpy(float), np.nan_to_num(pdf.value.to_numpy(float))
        x0, y0 = float(pdf.tx.iloc[0]), float(pdf.ty.iloc[0])
        p, damp = np.array([v[np.argmax(np.abs(v))], 1.0, x0, y0]), 1e-3
        free = 4 if search else 2

        def parts(p):
            dx, dy = x - p[2], y - p[3]
            e = np.exp(-(dx**2 + dy**2) / (2 * p[1] ** 2))
            return p[0] * e, np.stack([e, p[0] * e * (dx**2 + dy**2) / p[1] ** 3, p[0] * e * dx / p[1] ** 2, p[0] * e * dy / p[1] ** 2], 1)[:, :free]

        value, j = parts(p)
        cost = ((v - value) ** 2).sum()
        for _ in range(iterations):
            a = j.T @ j
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (v - value), rcond=None)[0]
            q = p.copy()
            q[:free] += step
            q[1] = np.clip(abs(q[1]), 0.05, 50)
            q[2], q[3] = np.clip(q[2], x0 - search, x0 + search), np.clip(q[3], y0 - search, y0 + search)
            new, jn = parts(q)
            c = ((v - new) ** 2).sum()
            if c <= cost:
                done = cost - c <= 1e-14 * cost
                p, value, j, cost, damp = q, new, jn, c, damp / 5
                if done:
                    break
            else:
                damp *= 5
        return pd.DataFrame([(pdf.map_id.iloc[0], pdf.target.iloc[0], *p)], columns=[c.split()[0] for c in GAUSS_SCHEMA.split(", ")])

    return near.groupBy("map_id", "target").applyInPandas(run, GAUSS_SCHEMA)
