"""Queries over resampling, hypotheses, regressions, photometry and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import coords as fx
from framewright.operators import evaluate as ev
from framewright.operators import joins, masks, models, scans, tiles
from framewright.operators import series as ts
from framewright.plans.basic import CORR, CUBE, FRAMES, ITEMS, OBSCON, PREDICTORS, READINGS, _pairs, grid
from framewright.sources import tables as src

QUERIES, ORACLES = {}, {}
SIGMA = 1.2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n) + 0.0


#: A bilinear share of a cell at distance d on one axis.
SHARE = "greatest(0, 1 - abs({a} - {b}))"


@query(f"""WITH {CUBE}, m AS (SELECT x, y, avg(value) AS v FROM cube GROUP BY 1, 2), p AS (SELECT DISTINCT x, y FROM cube),
    s AS (SELECT p.x, p.y, sum(v * {SHARE.format(a='m.x + 1.3', b='p.x')} * {SHARE.format(a='m.y - 2.6', b='p.y')}) AS value FROM p, m WHERE abs(m.x + 1.3 - p.x) < 1 AND abs(m.y - 2.6 - p.y) < 1 GROUP BY 1, 2)
    SELECT x, y, round(value, 6) + 0.0 AS value FROM s""")
def shift_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    m = cube.groupBy("dataset", "x", "y").agg(F.avg("value").alias("value"))
    return joins.shifted(m, 1.3, -2.6, ["dataset"], *grid(m)).select("x", "y", _r("value").alias("value"))


TURNED = """turned AS (SELECT frame, x, y, sx / 2 - 0.5 + (x - (sx / 2 - 0.5)) * cos(radians(-parang)) - (y - (sy / 2 - 0.5)) * sin(radians(-parang)) AS px,
    sy / 2 - 0.5 + (x - (sx / 2 - 0.5)) * sin(radians(-parang)) + (y - (sy / 2 - 0.5)) * cos(radians(-parang)) AS py FROM cube JOIN frames USING (frame), dim)"""


@query(f"""WITH {CUBE}, {FRAMES}, {TURNED} SELECT t.frame, t.x, t.y, round(coalesce(c.value, 0), 6) + 0.0 AS value
    FROM turned t LEFT JOIN cube c ON c.frame = t.frame AND c.x = floor(px + 0.5) AND c.y = floor(py + 0.5)""")
def derotate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    out = joins.derotated(cube, src.frames(cube), *grid(cube), order=0)
    return out.select("frame", "x", "y", _r("value").alias("value"))


@query(f"""WITH {CUBE}, {FRAMES}, {TURNED}, k AS (SELECT * FROM range(0, 2) a(i), range(0, 2) b(j)),
    s AS (SELECT t.frame, t.x, t.y, sum(coalesce(c.value, 0) * {SHARE.format(a='floor(px) + i', b='px')} * {SHARE.format(a='floor(py) + j', b='py')}) AS v
      FROM turned t CROSS JOIN k LEFT JOIN cube c ON c.frame = t.frame AND c.x = floor(px) + i AND c.y = floor(py) + j GROUP BY 1, 2, 3)
    SELECT s.x, s.y, CASE WHEN (s.x - (sx / 2 - 0.5)) * (s.x - (sx / 2 - 0.5)) + (s.y - (sy / 2 - 0.5)) * (s.y - (sy / 2 - 0.5)) < 81 THEN round(avg(v), 6) + 0.0 END AS mean,
      CASE WHEN (s.x - (sx / 2 - 0.5)) * (s.x - (sx / 2 - 0.5)) + (s.y - (sy / 2 - 0.5)) * (s.y - (sy / 2 - 0.5)) < 81 THEN round(median(v), 6) + 0.0 END AS median FROM s, dim GROUP BY s.x, s.y, sx, sy""")
def derotate_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(cube)
    out = joins.derotated(cube, src.frames(cube), sx, sy)
    inside = masks.circle(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), 9.0)
    g = out.groupBy("x", "y").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))
    return g.select("x", "y", *[masks.null_outside(_r(c), inside).alias(c) for c in ("mean", "median")])


STAMP = f"""psf AS (SELECT i AS tx, j AS ty, exp(-((i - 4) * (i - 4) + (j - 4) * (j - 4)) / (2 * {SIGMA} * {SIGMA})) AS tv FROM range(0, 9) a(i), range(0, 9) b(j)),
    pos AS (SELECT frame, 6 * cos(radians(45 + 90 - parang)) + sx / 2 - 0.5 AS px, 6 * sin(radians(45 + 90 - parang)) + sy / 2 - 0.5 AS py FROM frames, dim),
    added AS (SELECT c.frame, c.x, c.y, sum(tv * pow(10, -1.5 / 2.5) * {SHARE.format(a='px - 4 + tx', b='c.x')} * {SHARE.format(a='py - 4 + ty', b='c.y')}) AS a
      FROM cube c JOIN pos USING (frame), psf WHERE abs(px - 4 + tx - c.x) < 1 AND abs(py - 4 + ty - c.y) < 1 GROUP BY 1, 2, 3)"""


@query(f"WITH {CUBE}, {FRAMES}, {STAMP} SELECT frame, x, y, round(value + coalesce(a, 0), 6) + 0.0 AS value FROM cube LEFT JOIN added USING (frame, x, y)")
def template_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    out, _ = joins.injected(cube, src.frames(cube), src.gaussian_template(9, SIGMA), 9, 6.0, 45.0, 1.5, *grid(cube))
    return out.select("frame", "x", "y", _r("value").alias("value"))


@query(f"""WITH {CUBE}, {FRAMES}, {STAMP}, m AS (SELECT x, y, frame, coalesce(a, 0) AS a FROM cube LEFT JOIN added USING (frame, x, y)),
    t AS (SELECT x, y, max(a) AS top, arg_max(frame, round(a, 9) * 100000 - frame) AS peak FROM m GROUP BY 1, 2)
    SELECT x, y, round(top / (SELECT max(top) FROM t), 6) AS share, peak FROM (SELECT x, y, top, (SELECT min(frame) FROM m WHERE m.x = t.x AND m.y = t.y AND round(m.a, 9) = round(t.top, 9)) AS peak FROM t) WHERE top >= 0.5 * (SELECT max(top) FROM t)""")
def affected_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that the overlay reaches with half of its largest value, and the frame where it peaks there."""
    cube = src.dense_cube(spark, sf_dir)
    zero = cube.withColumn("value", F.lit(0.0))
    out, _ = joins.injected(zero, src.frames(cube), src.gaussian_template(9, SIGMA), 9, 6.0, 45.0, 1.5, *grid(cube))
    best = out.groupBy("dataset", "x", "y").agg(F.max("value").alias("top"), F.max(F.struct(F.round("value", 9), (-F.col("frame")).alias("f"))).alias("b"))
    share = ts.over_largest(F.col("top"), ["dataset"])
    return best.withColumn("share", share).filter("share >= 0.5").select("x", "y", F.round("share", 6).alias("share"), (-F.col("b.f")).cast("int").alias("peak"))


EXPECTED = f"""sig AS (SELECT DISTINCT CAST(floor(i * (CAST(last AS DOUBLE) / 7) + 1e-9) AS INT) AS signal_time FROM dim, range(0, 8) r(i)),
    t AS (SELECT x, y, x - (sx / 2 - 0.5) AS dx, y - (sy / 2 - 0.5) AS dy FROM (SELECT DISTINCT x, y FROM cube), dim WHERE (x - (sx / 2 - 0.5)) * (x - (sx / 2 - 0.5)) + (y - (sy / 2 - 0.5)) * (y - (sy / 2 - 0.5)) < 36),
    path AS (SELECT x, y, signal_time, f.frame, dx * cos(radians(f.parang - a.parang)) - dy * sin(radians(f.parang - a.parang)) AS ex, dx * sin(radians(f.parang - a.parang)) + dy * cos(radians(f.parang - a.parang)) AS ey, dx, dy
      FROM t, sig JOIN frames a ON a.frame = signal_time, frames f),
    raw AS (SELECT x, y, signal_time, frame, CASE WHEN ex + sx / 2 - 0.5 BETWEEN 0 AND sx - 1 AND ey + sy / 2 - 0.5 BETWEEN 0 AND sy - 1 THEN
      CASE WHEN abs(ex - dx) <= 4 AND abs(ey - dy) <= 4 THEN exp(-((ex - dx) * (ex - dx) + (ey - dy) * (ey - dy)) / (2 * {SIGMA} * {SIGMA})) ELSE 0 END END AS v FROM path, dim),
    expected AS (SELECT x, y, signal_time, frame, v / nullif(max(v) OVER (PARTITION BY x, y, signal_time), 0) AS expected FROM raw)"""


def _expected(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(cube)
    pixels = src.series(spark, sf_dir).filter(masks.circle(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), 6.0))
    targets = pixels.select("dataset", F.col("x").alias("tx"), F.col("y").alias("ty")).join(ts.signal_times(cube.select("dataset", "frame"), k), "dataset")
    out = joins.expected_series(targets, src.frames(cube), 4.0, SIGMA, sx, sy)
    return out.withColumnsRenamed({"tx": "x", "ty": "y"}).drop("dataset")


@query(f"WITH {CUBE}, {FRAMES}, {EXPECTED} SELECT x, y, signal_time, frame, round(expected, 6) + 0.0 AS expected FROM expected")
def expected_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expected(spark, sf_dir).select("x", "y", "signal_time", "frame", _r("expected").alias("expected"))


RESIDUAL = """res AS (SELECT x, y, frame, value - avg(value) OVER (PARTITION BY x, y) AS value FROM cube)"""
HYPOTHESIS = """sim AS (SELECT x, y, signal_time, round_even(greatest(0, least(1, sum(value * expected) / nullif(sqrt(sum(value * value) * sum(expected * expected)), 0))), 3) AS s
      FROM res JOIN expected USING (x, y, frame) GROUP BY 1, 2, 3 HAVING count(*) = count(expected)),
    best AS (SELECT x, y, signal_time, s FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY s DESC, signal_time) AS k FROM sim) WHERE k = 1)"""


def _residual(cube: DataFrame) -> DataFrame:
    return cube.select("x", "y", "frame", (F.col("value") - F.avg("value").over(Window.partitionBy("x", "y"))).alias("value"))


def _hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    expected = _expected(spark, sf_dir)
    res = _residual(src.dense_cube(spark, sf_dir))
    times = expected.select("x", "y", "signal_time").distinct()
    return res, expected, ev.best_hypothesis(res.join(times, ["x", "y"]), expected, 0.1)


@query(f"WITH {CUBE}, {FRAMES}, {EXPECTED}, {RESIDUAL}, {HYPOTHESIS} SELECT x, y, CASE WHEN s > 0.1 THEN signal_time END AS signal_time, s AS similarity FROM best")
def best_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hypotheses(spark, sf_dir)[2]


@query(f"""WITH {CUBE}, {FRAMES}, {EXPECTED}, {RESIDUAL}, {HYPOTHESIS}, picked AS MATERIALIZED (SELECT x, y, signal_time, s FROM best WHERE s > 0.1 AND x % 2 = 0),
    own AS MATERIALIZED (SELECT e.x, e.y, e.frame, e.expected * s AS share FROM expected e JOIN picked USING (x, y, signal_time))
    SELECT r.x, r.y, r.frame, round(CASE WHEN o.frame IS NULL THEN value ELSE value - share END, 6) + 0.0 AS value FROM res r LEFT JOIN own o USING (x, y, frame)""")
def residual_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual with the expected signal taken out at selected pixels that have a signal time, the plain one elsewhere."""
    res, expected, best = _hypotheses(spark, sf_dir)
    share = best.select("x", "y", "similarity")
    own = expected.join(res, ["x", "y", "frame"]).join(share, ["x", "y"]).select("x", "y", "signal_time", "frame", (F.col("value") - F.col("expected") * F.col("similarity")).alias("value"))
    out = ev.residual_pick(res, own, best.withColumn("selected", F.col("x") % 2 == 0))
    return out.select("x", "y", "frame", _r("value").alias("value"))


@query(f"""WITH {CUBE}, {FRAMES}, {EXPECTED}, {RESIDUAL}, {HYPOTHESIS}, aff AS (SELECT b.x AS tx, b.y AS ty, q.x, q.y, b.signal_time FROM best b, t q WHERE s > 0.1 AND (q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y) < 9),
    c AS (SELECT tx, ty, a.x, a.y, coalesce(sum(value * expected) / nullif(sqrt(sum(value * value) * sum(expected * expected)), 0), 0) AS s
      FROM aff a JOIN expected e ON e.x = a.x AND e.y = a.y AND e.signal_time = a.signal_time JOIN res r ON r.x = a.x AND r.y = a.y AND r.frame = e.frame WHERE NOT (tx = a.x AND ty = a.y) GROUP BY 1, 2, 3, 4)
    SELECT tx, ty, round(avg(s), 6) + 0.0 AS mean, round(median(s), 6) + 0.0 AS median FROM c GROUP BY 1, 2""")
def match_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the neighbours of each pixel follow its hypothesis at their own expected series."""
    res, expected, best = _hypotheses(spark, sf_dir)
    targets = best.filter("signal_time is not null").select(F.col("x").alias("tx"), F.col("y").alias("ty"), "signal_time").withColumn("dataset", F.lit("dense"))
    pixels = expected.select("x", "y").distinct().withColumn("dataset", F.lit("dense"))
    near = joins.near_pairs(targets, pixels, 3.0, ["dataset"]).drop("dataset")
    met = near.join(expected, ["x", "y", "signal_time"]).join(res, ["x", "y", "frame"])
    return ev.match_fractions(met).select("tx", "ty", _r("mean").alias("mean"), _r("median").alias("median"))


@query(f"""WITH {ITEMS}, {OBSCON}, c AS (SELECT x, y, key, {CORR.format(a='i.value', b='o.value')} AS r FROM items i JOIN obscon o USING (frame) GROUP BY 1, 2, 3)
    SELECT x, y, key, round(r, 6) AS r FROM c WHERE abs(r) <= 0.25""")
def gated_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates that may serve as predictors of a pixel: those not too much like its own signal."""
    o = src.obscon(spark, sf_dir).select("dataset", "frame", "key", F.col("value").alias("o"))
    met = src.item_cube(spark, sf_dir).join(o, ["dataset", "frame"])
    r = met.groupBy("x", "y", "key").agg(ts.pearson(F.col("value"), F.col("o")).alias("r"))
    return r.filter(F.abs("r") <= 0.25).select("x", "y", "key", F.round("r", 6).alias("r"))


MOMENTS = f"""{PREDICTORS}, mom AS (SELECT tx, ty, p.x, p.y, b.frame % 3 AS fold, count(*) AS n, sum(a.value) AS sa, sum(b.value) AS sb, sum(a.value * a.value) AS saa, sum(a.value * b.value) AS sab
    FROM pairs p JOIN cube a ON a.x = p.x AND a.y = p.y JOIN cube b ON b.x = tx AND b.y = ty AND a.frame = b.frame GROUP BY 1, 2, 3, 4, 5)"""


@query(f"WITH {CUBE}, {MOMENTS} SELECT tx, ty, x, y, CAST(fold AS INT) AS fold, n, round(sa, 5) + 0.0 AS sa, round(sb, 5) + 0.0 AS sb, round(saa, 5) AS saa, round(sab, 5) + 0.0 AS sab FROM mom")
def fold_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    m = models.fold_moments(_pairs(src.series(spark, sf_dir).select("dataset", "x", "y"), *grid(cube)), cube, 3)
    return m.select("tx", "ty", "x", "y", F.col("fold").cast("int").alias("fold"), "n", *[_r(c, 5).alias(c) for c in ("sa", "sb", "saa", "sab")])


@query(f"""WITH {CUBE}, {MOMENTS}, tr AS (SELECT tx, ty, x, y, fold, sum(n) OVER w - n AS n, sum(sa) OVER w - sa AS sa, sum(sb) OVER w - sb AS sb, sum(saa) OVER w - saa AS saa, sum(sab) OVER w - sab AS sab
      FROM mom WINDOW w AS (PARTITION BY tx, ty, x, y))
    SELECT tx, ty, x, y, CAST(fold AS INT) AS fold, round((sab - sa * sb / n) / (saa - sa * sa / n + 10.0), 5) + 0.0 AS slope FROM tr""")
def moment_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge slopes of every fold from the moments: no row is read twice."""
    cube = src.dense_cube(spark, sf_dir)
    m = models.fold_moments(_pairs(src.series(spark, sf_dir).select("dataset", "x", "y"), *grid(cube)), cube, 3)
    return models.moment_ridge(m, 10.0).select("tx", "ty", "x", "y", F.col("fold").cast("int").alias("fold"), _r("slope", 5).alias("slope"))


@query(f"""WITH {CUBE}, o AS (SELECT a.x AS tx, a.y AS ty, a.frame, a.value AS b, b.value AS a FROM cube a, cube b, dim WHERE a.frame = b.frame AND b.x = sx - 1 - a.x AND b.y = sy - 1 - a.y),
    f AS (SELECT tx, ty, regr_slope(b, a) AS m, regr_intercept(b, a) AS c FROM o GROUP BY 1, 2)
    SELECT tx, ty, frame, round(b - m * a - c, 5) + 0.0 AS residual FROM o JOIN f USING (tx, ty)""")
def mirror_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of every pixel on its mirror image, all frames at once, through the same fit as any number of predictors."""
    s = src.series(spark, sf_dir)
    mirror = tiles.PredictorMask(*grid(s), 0.0, 0.5, 0.0)
    out = tiles.fit_tiles(s, s.select("dataset", F.col("x").alias("tx"), F.col("y").alias("ty")), mirror, folds=1, model="LinearRegression")
    return out.select("tx", "ty", F.posexplode("residual").alias("frame", "r")).select("tx", "ty", F.col("frame").cast("int").alias("frame"), _r("r", 5).alias("residual"))


def _fits(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    s = src.series(spark, sf_dir)
    sx, sy = grid(s)
    e = None
    if mode != "default":
        rows = _expected(spark, sf_dir, 3).groupBy(F.col("x").alias("tx"), F.col("y").alias("ty"), "signal_time")
        e = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "expected"))), lambda p: p["expected"]).alias("e"))
    pairs = _pairs(s.select("dataset", "x", "y"), sx, sy, 6.0)
    alphas = [0.1 * 1000 ** (k / 15) for k in range(16)]
    out = models.fit_pixels(pairs, s, e, 3, "RidgeCV", alphas, mode)
    rms = F.sqrt(F.aggregate("residual", F.lit(0.0), lambda a, r: a + r * r) / F.size("residual"))
    return out.select("tx", "ty", "signal_time", F.when(~F.isnan(rms), F.round(rms, 6)).alias("rms"), F.when(~F.isnan("signal"), F.round("signal", 6)).alias("signal"), F.size("px").alias("n_predictors"))


@query()
def pixel_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir, "default")


@query()
def pixel_models_signal_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir, "signal_fitting")


@query()
def pixel_models_signal_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir, "signal_masking")


@query()
def coefficient_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coefficient of each predictor of each target, over the largest of the target."""
    s = src.series(spark, sf_dir)
    fits = models.fit_pixels(_pairs(s.select("dataset", "x", "y"), *grid(s), 6.0), s, folds=3, model="Ridge", alphas=[1.0])
    rows = fits.select("tx", "ty", F.explode(F.arrays_zip("px", "py", "coefficients")).alias("c")).select("tx", "ty", F.col("c.px").alias("x"), F.col("c.py").alias("y"), F.col("c.coefficients").alias("c"))
    return rows.select("tx", "ty", "x", "y", _r(ts.over_largest(F.col("c"), ["tx", "ty"], True)).alias("share"))


@query()
def pca_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of each pixel that is left after 1, 5 and 10 components."""
    out, _ = models.pca_residuals(src.dense_cube(spark, sf_dir), [1, 5, 10])
    return out.groupBy("n", "x", "y").agg(_r(F.avg(F.col("value") * F.col("value"))).alias("left"))


@query()
def pixel_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.clustered(src.series(spark, sf_dir))


@query()
def covariates_at_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings interpolated at every reading time of any parameter, rounded up to five minutes."""
    r = src.readings(spark, sf_dir)
    integrals = ts.running_integral(r).select("parameter", "t", "integral")
    times = r.select(F.unix_timestamp(fx.round_minutes(F.col("ts"), True)).cast("double").alias("t")).distinct()
    every = times.join(F.broadcast(r.select("parameter").distinct()))  # a handful of parameter names
    return models.interpolated(integrals, every).select("parameter", "t", _r("value", 4).alias("value"))


MAPS = "maps AS (SELECT CAST(frame // 8 AS INT) AS map_id, x, y, avg(value) AS value FROM cube GROUP BY 1, 2, 3)"


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    return cube.groupBy(F.floor(F.col("frame") / 8).cast("int").alias("map_id"), "x", "y").agg(F.avg("value").alias("value"))


def _share(dx: str, dy: str, r: float) -> str:
    return f"(SELECT count(*) / 100.0 FROM range(0, 100) k(k) WHERE pow({dx} - 0.5 + (floor(k / 10) + 0.5) / 10, 2) + pow({dy} - 0.5 + (k % 10 + 0.5) / 10, 2) <= {r * r})"


@query(f"""WITH {CUBE}, {MAPS}, sub AS (SELECT (i + 0.5) / 10 - 0.5 AS u, (j + 0.5) / 10 - 0.5 AS w FROM range(0, 10) a(i), range(0, 10) b(j)),
    pos AS (SELECT k, 5 * cos(radians(k * 60) + pi() / 2) + sx / 2 - 0.5 AS px, 5 * sin(radians(k * 60) + pi() / 2) + sy / 2 - 0.5 AS py FROM dim, range(0, 6) r(k))
    SELECT map_id, CAST(k AS INT) AS target, round(sum(value / 100), 6) + 0.0 AS flux FROM maps, pos, sub WHERE abs(x - px) <= 3 AND abs(y - py) <= 3 AND pow(x - px + u, 2) + pow(y - py + w, 2) <= 4.0 GROUP BY 1, 2""")
def aperture_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    sx, sy = grid(maps)
    px, py = fx.polar_to_cartesian(F.lit(5.0), F.radians(F.col("target") * 60), fx.center(sx), fx.center(sy))
    pos = maps.select("map_id").distinct().withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("map_id", "target", px.alias("px"), py.alias("py"))
    return ev.aperture_sums(maps, pos, 2.0, ["map_id"], ["map_id", "target"]).select("map_id", "target", _r("flux").alias("flux"))


RING = """tg AS (SELECT map_id, k AS target, 5.0 + k AS sep, 40.0 * k AS angle, degrees(2 * asin(1.5 / (5.0 + k))) AS opening FROM (SELECT DISTINCT map_id FROM maps), range(0, 3) r(k)),
    tn AS (SELECT *, 360 - 4 * opening AS arc, CAST(floor(round((360 - 4 * opening) / opening, 1)) AS INT) + 1 AS n FROM tg),
    ring AS (SELECT map_id, target, sep, n, i, arc / (n - 1) AS step, angle + 2 * opening + i * arc / (n - 1) AS ref_angle FROM tn, range(0, 64) r(i) WHERE i < n)"""


@query(f"WITH {CUBE}, {MAPS}, {RING} SELECT map_id, CAST(target AS INT) AS target, CAST(i AS INT) AS i, n, round(ref_angle, 6) AS ref_angle FROM ring")
def reference_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ring_positions(_targets(_maps(spark, sf_dir)), 1.5).select("map_id", "target", "i", "n", F.round("ref_angle", 6).alias("ref_angle"))


def _targets(maps: DataFrame) -> DataFrame:
    ids = maps.select("map_id").distinct().withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return ids.select("map_id", "target", (5.0 + F.col("target")).alias("sep"), (40.0 * F.col("target")).alias("angle"))


@query(f"""WITH {CUBE}, {MAPS}, {RING}, rot AS (SELECT ring.*, q AS rotation, ref_angle + q * step / 5 AS a FROM ring, range(0, 5) r(q) WHERE q = 0 OR i < n - 1),
    pos AS (SELECT map_id, target, rotation, i, FALSE AS own, 0.5 AS r, sep * cos(radians(a) + pi() / 2) + sx / 2 - 0.5 AS px, sep * sin(radians(a) + pi() / 2) + sy / 2 - 0.5 AS py FROM rot, dim
      UNION ALL SELECT map_id, target, 0, 0, TRUE, 1.5, sep * cos(radians(angle) + pi() / 2) + sx / 2 - 0.5, sep * sin(radians(angle) + pi() / 2) + sy / 2 - 0.5 FROM tg, dim),
    sub AS (SELECT (i + 0.5) / 10 - 0.5 AS u, (j + 0.5) / 10 - 0.5 AS w FROM range(0, 10) a(i), range(0, 10) b(j)),
    fl AS (SELECT p.map_id, target, rotation, p.i, own, sum(CASE WHEN pow(x - px + u, 2) + pow(y - py + w, 2) <= r * r THEN value / 100 ELSE 0 END) AS flux
      FROM pos p JOIN maps m ON m.map_id = p.map_id AND abs(x - px) < 2.5 AND abs(y - py) < 2.5, sub GROUP BY 1, 2, 3, 4, 5),
    st AS (SELECT map_id, target, rotation, avg(flux) AS m2, stddev_samp(flux) * sqrt(1 + 1.0 / count(*)) AS noise FROM fl WHERE NOT own GROUP BY 1, 2, 3)
    SELECT st.map_id, CAST(st.target AS INT) AS target, CAST(st.rotation AS INT) AS rotation, round(o.flux - m2, 5) + 0.0 AS signal, round(noise, 5) AS noise, round((o.flux - m2) / noise, 4) + 0.0 AS snr
    FROM st JOIN fl o ON o.own AND o.map_id = st.map_id AND o.target = st.target""")
def ring_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    sx, sy = grid(maps)
    out = ev.target_metrics(maps, _targets(maps), sx / 2 - 0.5, sy / 2 - 0.5, 1.5, rotations=4)
    return out.select("map_id", "target", "rotation", _r("signal", 5).alias("signal"), F.round("noise", 5).alias("noise"), _r("snr", 4).alias("snr"))


@query()
def target_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every target, summed up over the rotations of its ring."""
    maps = _maps(spark, sf_dir)
    sx, sy = grid(maps)
    tests = ev.with_fpf(ev.target_metrics(maps, _targets(maps), sx / 2 - 0.5, sy / 2 - 0.5, 1.5))
    return ev.summary(tests, ["map_id", "target"], ["signal", "noise", "snr", "fpf", "log_fpf", "p_value"])


@query()
def gaussian_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    sx, sy = grid(maps)
    px, py = fx.polar_to_cartesian(F.col("sep"), F.radians("angle"), fx.center(sx), fx.center(sy))
    fits = ev.gaussian_fluxes(maps, _targets(maps).select("map_id", "target", px.alias("px"), py.alias("py")), search=1.0)
    return fits.select("map_id", "target", F.round(fx.gaussian_integral(F.col("amplitude"), F.col("sigma")), 4).alias("flux"), F.round(F.col("sigma") * (2 * math.sqrt(2 * math.log(2))), 4).alias("fwhm"))


@query(f"""WITH {CUBE}, {MAPS}, off AS (SELECT CAST(k AS INT) AS k, -1.0::DOUBLE + (k % 21) * (2.0::DOUBLE / 20) AS ox, -1.0::DOUBLE + (k // 21) * (2.0::DOUBLE / 20) AS oy FROM range(0, 441) r(k)),
    pos AS (SELECT t, k, (5 + t) * cos(radians(40 * t) + pi() / 2) + sx / 2 - 0.5 + ox AS px, (5 + t) * sin(radians(40 * t) + pi() / 2) + sy / 2 - 0.5 + oy AS py FROM dim, range(0, 3) r(t), off),
    sub AS (SELECT (i + 0.5) / 10 - 0.5 AS u, (j + 0.5) / 10 - 0.5 AS w FROM range(0, 10) a(i), range(0, 10) b(j)),
    share AS MATERIALIZED (SELECT t, k, px, py, q.x, q.y, count(*) / 100.0::DOUBLE AS s FROM pos JOIN (SELECT DISTINCT x, y FROM cube) q ON abs(q.x - px) < 2.5 AND abs(q.y - py) < 2.5, sub WHERE pow(q.x - px + u, 2) + pow(q.y - py + w, 2) <= 2.25 GROUP BY 1, 2, 3, 4, 5, 6),
    fl AS (SELECT map_id, t, k, px, py, round(sum(s * value), 12) AS flux FROM share JOIN maps USING (x, y) GROUP BY 1, 2, 3, 4, 5),
    best AS (SELECT *, row_number() OVER (PARTITION BY map_id, t ORDER BY flux DESC, k) AS place FROM fl)
    SELECT map_id, CAST(t AS INT) AS target, round(flux, 5) AS flux, round(px, 5) AS px, round(py, 5) AS py FROM best WHERE place = 1""")
def brightest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    sx, sy = grid(maps)
    px, py = fx.polar_to_cartesian(F.col("sep"), F.radians("angle"), fx.center(sx), fx.center(sy))
    pos = _targets(maps).select("map_id", "target", px.alias("px"), py.alias("py"))
    return ev.brightest_offset(maps, pos, 1.5, 1.0, ["map_id"], ["map_id", "target"]).select("map_id", "target", *[F.round(c, 5).alias(c) for c in ("flux", "px", "py")])


@query(f"""WITH {CUBE}, {MAPS} SELECT a.map_id, a.x, a.y, round(a.value, 6) AS value FROM maps a WHERE NOT EXISTS (SELECT 1 FROM maps b WHERE b.map_id = a.map_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) AND b.value >= a.value)""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.local_maxima(_maps(spark, sf_dir)).select("map_id", "x", "y", F.round("value", 6).alias("value"))


@query(f"""WITH {CUBE}, {MAPS}, m AS (SELECT map_id, sqrt(pow(x - (sx / 2 - 0.5), 2) + pow(y - (sy / 2 - 0.5), 2)) AS r, value AS b FROM maps, dim WHERE abs(value) > 0.05)
    SELECT map_id, round(r, 6) AS r, round(b, 6) AS brightness FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.map_id = m.map_id AND abs(o.r - m.r) <= 2 AND o.b > m.b)""")
def pruned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir).filter(F.abs("value") > 0.05)
    sx, sy = grid(src.series(spark, sf_dir))
    r = F.sqrt(F.pow(F.col("x") - fx.center(sx), 2) + F.pow(F.col("y") - fx.center(sy), 2))
    out = masks.without_weaker_neighbours(maps.select("map_id", r.alias("r"), F.col("value").alias("brightness")), reach=2.0)
    return out.select("map_id", F.round("r", 6).alias("r"), F.round("brightness", 6).alias("brightness"))


RESULTS = """results AS (SELECT 2.0 + l_linenumber % 7 AS separation, 5.0 + floor(l_quantity / 4) * 0.5 AS expected_contrast, substr('abcdef', CAST(l_suppkey % 6 + 1 AS INT), 1) AS azimuthal_position,
    l_discount * 10 AS throughput, pow(10, -(12 - floor(l_quantity / 4) * 0.8 + l_tax * 10)) AS fpf_median FROM lineitem)"""


@query(f"""WITH {RESULTS}, g AS (SELECT CAST(separation AS DOUBLE) AS separation, CAST(expected_contrast AS DOUBLE) AS c, median(-log10(fpf_median)) - 6.54265420327721 AS f FROM results GROUP BY 1, 2),
    n AS (SELECT *, min(c) OVER (PARTITION BY separation) AS lo, max(c) OVER (PARTITION BY separation) AS hi, lead(c) OVER w AS c2, lead(f) OVER w AS f2 FROM g WINDOW w AS (PARTITION BY separation ORDER BY c))
    SELECT separation, round(max(CASE WHEN (f > 0) <> (f2 > 0) THEN lo + (floor((c + f / (f - f2) * (c2 - c) - lo) / ((hi - lo) / 10000)) + 0.5) * ((hi - lo) / 10000) END), 6) AS "limit" FROM n GROUP BY 1""")
def detection_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.detection_limits(src.results(spark, sf_dir))
    return out.select("separation", F.round("limit", 6).alias("limit"))


@query(f"""WITH {RESULTS} SELECT CAST(expected_contrast AS DOUBLE) AS expected_contrast, {', '.join(f'round(median(throughput) FILTER (separation = {s}), 6) AS s{s}' for s in (2, 3, 4, 5, 6, 7, 8))} FROM results GROUP BY 1""")
def throughput_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.results(spark, sf_dir).withColumn("s", F.concat(F.lit("s"), F.col("separation").cast("int")))
    out = rows.groupBy("expected_contrast").pivot("s", [f"s{k}" for k in range(2, 9)]).agg(F.round(F.median("throughput"), 6))
    return out.orderBy("expected_contrast")


@query(f"""WITH {RESULTS} SELECT CAST(separation AS DOUBLE) AS separation, printf('%.2f (-%.2f/+%.2f)', median(throughput), median(throughput) - min(throughput), max(throughput) - median(throughput)) AS label FROM results WHERE expected_contrast < 9 GROUP BY 1""")
def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = src.results(spark, sf_dir).filter("expected_contrast < 9").groupBy("separation").agg(F.median("throughput").alias("m"), F.min("throughput").alias("a"), F.max("throughput").alias("b"))
    return g.select("separation", F.format_string("%.2f (-%.2f/+%.2f)", "m", F.col("m") - F.col("a"), F.col("b") - F.col("m")).alias("label"))


@query(f"""WITH {RESULTS}, a AS (SELECT DISTINCT separation FROM results), b AS (SELECT DISTINCT expected_contrast FROM results), c AS (SELECT DISTINCT azimuthal_position AS p FROM results)
    SELECT printf('%.2f__%.1f__%s', expected_contrast, separation, p) AS name, CAST(CASE p WHEN 'a' THEN 270 WHEN 'b' THEN 330 WHEN 'c' THEN 30 WHEN 'd' THEN 90 WHEN 'e' THEN 150 ELSE 210 END AS DOUBLE) AS angle FROM a, b, c""")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contrast at every separation and azimuth that occurs: the few distinct values of each."""
    r = src.results(spark, sf_dir)
    lists = r.agg(*[F.collect_set(c).alias(c) for c in ("separation", "expected_contrast", "azimuthal_position")])
    rows = lists
    for c in lists.columns:
        rows = rows.withColumn(c, F.explode(c))
    return rows.select(F.format_string("%.2f__%.1f__%s", "expected_contrast", "separation", "azimuthal_position").alias("name"), fx.injection_angle(F.col("azimuthal_position")).alias("angle"))


BLOCKS = """seq AS (SELECT event_type AS parameter, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx FROM events),
    b AS (SELECT parameter, date_trunc('day', ts) AS day, count(*) AS n, min(epoch_us(ts) / 1e6) AS t0, max(epoch_us(ts) / 1e6) AS t1 FROM seq GROUP BY 1, 2),
    o AS (SELECT *, sum(n) OVER (PARTITION BY parameter ORDER BY day ROWS UNBOUNDED PRECEDING) - n AS start FROM b)"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = src.readings(spark, sf_dir)
    rows = scans.numbered(r.select("parameter", "ts"), ["parameter"], ["ts"], F.date_trunc("day", "ts"), "idx").select("parameter", "ts", "idx")
    t = F.unix_micros("ts") / 1e6
    b = r.groupBy("parameter", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    return rows, ts.block_offsets(b, "parameter", "day", "n")


@query(f"WITH {BLOCKS} SELECT o.parameter, CAST(start AS BIGINT) AS start, count(*) AS found, n AS wanted FROM o JOIN seq s ON s.parameter = o.parameter AND idx >= start AND idx < start + n GROUP BY 1, 2, 4")
def frames_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, blocks = _blocks(spark, sf_dir)
    met = joins.in_blocks(rows, blocks, "idx", "parameter", 256)
    return met.groupBy("parameter", "start").agg(F.count("*").alias("found"), F.first("n").alias("wanted"))


@query(f"WITH {BLOCKS} SELECT parameter, CAST(start + i AS BIGINT) AS idx, round(t0 + i * coalesce((t1 - t0) / nullif(n - 1, 0), 0), 3) AS t FROM o, range(0, (SELECT max(n) FROM o)) r(i) WHERE i < n")
def spread_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in equal steps between the first and last of each day."""
    _, blocks = _blocks(spark, sf_dir)
    out = ts.spread(blocks, "n", "t0", "t1", "t")
    return out.select("parameter", (F.col("start") + F.col("i")).alias("idx"), F.round("t", 3).alias("t"))


@query("""SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-03 12:00:00' THEN 'new_' ELSE 'old_' END || event_type AS archive FROM events WHERE event_type <> 'error'""")
def catalogue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of each reading by its date: strictly later than the cut-over is new."""
    e = src.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("parameter"), F.col("ts").cast("timestamp").alias("ts"))
    cut = F.to_timestamp(F.lit("2024-01-03 12:00:00"))
    never = F.lit(None).cast("timestamp")
    spans = F.array(F.struct(F.lit("old_").alias("era"), never.alias("valid_from"), cut.alias("valid_to")), F.struct(F.lit("new_").alias("era"), cut.alias("valid_from"), never.alias("valid_to")))
    names = e.select("parameter").distinct().filter("parameter <> 'error'")
    dimension = names.select("parameter", F.inline(spans))
    met, _ = joins.valid_at(e, dimension, "parameter", "ts")
    return met.select("event_id", F.concat("era", "parameter").alias("archive"))


@query("""WITH h AS (SELECT o_orderstatus AS dataset, o_orderkey AS id, o_orderpriority AS a, CAST(o_custkey % 50 AS VARCHAR) AS b FROM orders),
    w AS (SELECT DISTINCT o_orderstatus AS dataset, CASE WHEN o_orderstatus = 'F' THEN '7' ELSE '1-URGENT' END AS name FROM orders),
    f AS (SELECT h.* FROM h WHERE EXISTS (SELECT 1 FROM w WHERE w.dataset = h.dataset AND w.name = a))
    SELECT dataset, id FROM f UNION ALL SELECT h.dataset, id FROM h WHERE dataset NOT IN (SELECT dataset FROM f) AND EXISTS (SELECT 1 FROM w WHERE w.dataset = h.dataset AND w.name = b)""")
def header_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders")
    h = o.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("a"), (F.col("o_custkey") % 50).cast("string").alias("b"))
    wanted = h.select("dataset").distinct().withColumn("name", F.when(F.col("dataset") == "F", "7").otherwise("1-URGENT"))
    return joins.matched_headers(h, wanted, "a", "b").select("dataset", "id")


@query(f"""WITH {CUBE}, {MAPS}, g AS (SELECT CAST(r AS INT) AS r, CAST(p AS INT) AS p, r * (least(sx, sy) / 2.0::DOUBLE / 32) AS d, p * (2 * pi() / 32) AS phi, floor(8.0 / least(sx, sy) * 32) AS zero FROM dim, range(0, 32) a(r), range(0, 32) b(p)),
    pt AS (SELECT r, p, zero, sx / 2 - 0.5 + d * cos(phi) AS px, sy / 2 - 0.5 + d * sin(phi) AS py FROM g, dim), k AS (SELECT * FROM range(0, 2) a(i), range(0, 2) b(j)), ids AS (SELECT DISTINCT map_id FROM maps),
    s AS (SELECT ids.map_id, r, p, any_value(zero) AS zero, sum(coalesce(value, 0) * {SHARE.format(a='floor(px) + i', b='px')} * {SHARE.format(a='floor(py) + j', b='py')}) AS v FROM ids, pt CROSS JOIN k LEFT JOIN maps m ON m.map_id = ids.map_id AND m.x = floor(px) + i AND m.y = floor(py) + j GROUP BY 1, 2, 3)
    SELECT map_id, r, p, round(v * CASE WHEN r < zero THEN 1e-8 ELSE 1e-8 + (r - zero) * ((1 - 1e-8) / greatest(32 - zero - 1, 1)) END, 6) + 0.0 AS value FROM s""")
def polar_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each map on a polar grid, weighted towards the edge."""
    maps = _maps(spark, sf_dir)
    sx, sy = grid(maps)
    points = joins.polar_points(maps, ["map_id"], 32, sx, sy)
    out = joins.sampled(maps, points, ["map_id"], ["map_id", "r", "p"])
    return out.select("map_id", "r", "p", _r(F.col("value") * masks.radial_weight(F.col("r"), 32, min(sx, sy))).alias("value"))


@query(f"""WITH RECURSIVE {CUBE}, {MAPS}, bright AS MATERIALIZED (SELECT map_id, x, y FROM maps WHERE value > 0.03),
    reach AS (SELECT map_id, x AS x0, y AS y0, x, y FROM bright UNION SELECT r.map_id, r.x0, r.y0, b.x, b.y FROM reach r JOIN bright b ON b.map_id = r.map_id AND b.x BETWEEN r.x - 1 AND r.x + 1 AND b.y BETWEEN r.y - 1 AND r.y + 1 AND abs(b.x - r.x) + abs(b.y - r.y) = 1)
    SELECT map_id, x0 AS x, y0 AS y FROM reach GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright cells of each map in components of at least three."""
    from framewright.sources.tables import checkpointed

    bright = _maps(spark, sf_dir).filter("value > 0.03").select("map_id", "x", "y")
    return masks.without_components(bright, checkpointed, least=3)


@query(f"""WITH {CUBE}, {MAPS}, z AS (SELECT map_id, x, y, CASE WHEN pow(x - 12, 2) + pow(y - 9, 2) < 25 THEN coalesce(value, 0) ELSE 0 END AS v FROM maps)
    SELECT map_id, round(sum(v), 6) + 0.0 AS total, count(*) FILTER (v <> 0) AS n FROM z GROUP BY 1""")
def masked_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _maps(spark, sf_dir).withColumn("v", masks.zero_outside(F.col("value"), F.col("x"), F.col("y"), 12, 9, 5.0))
    return rows.groupBy("map_id").agg(_r(F.sum("v")).alias("total"), F.sum((F.col("v") != 0).cast("long")).alias("n"))
