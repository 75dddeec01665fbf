"""Queries over fits with covariates: default model and all signal times in one run, tile by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import coords as fx
from framewright.operators import masks, resample, tiles
from framewright.operators import series as ts
from framewright.plans.basic import CUBE, FRAMES, grid
from framewright.plans.detection import EXPECTED, MAPS, _expected, _maps, _r
from framewright.sources import tables as src

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _fits(spark: SparkSession, sf_dir: str, radii: tuple[float, float, float], k: int, keys: list[str] | str, **how) -> DataFrame:
    """Fits of the pixels within 6 of the centre under ``k`` signal times, with the covariates ``keys``."""
    s = src.series(spark, sf_dir)
    sx, sy = grid(s)
    inside = masks.circle(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), 6.0)
    targets = s.filter(inside).select("dataset", F.col("x").alias("tx"), F.col("y").alias("ty"))
    rows = _expected(spark, sf_dir, k).groupBy(F.col("x").alias("tx"), F.col("y").alias("ty"), "signal_time")
    e = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "expected"))), lambda p: p["expected"]).alias("e")).withColumn("dataset", F.lit("dense"))
    covariates = ts.selected(src.covariates(spark, sf_dir), keys)
    return tiles.fit_tiles(s, targets, tiles.PredictorMask(sx, sy, *radii), e, covariates, **how)


@query(f"""WITH {CUBE}, {FRAMES}, {EXPECTED}, oc AS (SELECT CAST(event_id % 64 AS INT) AS frame, avg(CAST(value AS DOUBLE)) AS o FROM events WHERE event_type = 'click' GROUP BY 1),
    o AS MATERIALIZED (SELECT t.x, t.y, a.frame, a.value AS v, b.value AS p, coalesce(o, (SELECT avg(o) FROM oc)) AS o FROM t JOIN cube a ON a.x = t.x AND a.y = t.y CROSS JOIN dim JOIN cube b ON b.x = sx - 1 - t.x AND b.y = sy - 1 - t.y AND b.frame = a.frame LEFT JOIN oc ON oc.frame = a.frame),
    cases AS (SELECT x, y, -1 AS signal_time, frame, CAST(NULL AS DOUBLE) AS e FROM o UNION ALL SELECT x, y, signal_time, frame, expected FROM expected),
    j AS MATERIALIZED (SELECT o.*, signal_time, e, coalesce(e, 0) < 0.2 AS calm FROM o JOIN cases USING (x, y, frame)),
    g AS (SELECT x, y, signal_time, count(*) AS n, count(*) FILTER (calm) AS rest, count(e) < count(*) OR min(e) = max(e) AS free, covar_pop(e, o) / nullif(stddev_pop(e) * stddev_pop(o), 0) AS r,
      avg(v) FILTER (calm) AS mv, avg(p) FILTER (calm) AS mp, avg(o) FILTER (calm) AS mo, var_pop(p) FILTER (calm) AS pp, var_pop(o) FILTER (calm) AS oo, covar_pop(p, o) FILTER (calm) AS po, covar_pop(p, v) FILTER (calm) AS pv, covar_pop(o, v) FILTER (calm) AS ov FROM j GROUP BY 1, 2, 3),
    f AS (SELECT *, coalesce(free OR abs(r) <= 0.1, FALSE) AS used FROM g WHERE rest >= 0.33 * n),
    c AS (SELECT *, CASE WHEN used THEN (pv * oo - ov * po) / (pp * oo - po * po) ELSE pv / pp END AS cp, CASE WHEN used THEN (ov * pp - pv * po) / (pp * oo - po * po) ELSE 0 END AS co FROM f)
    SELECT x AS tx, y AS ty, CAST(signal_time AS INT) AS signal_time, frame, used, round(v - mv - cp * (p - mp) - co * (o - mo), 5) + 0.0 AS residual FROM j JOIN c USING (x, y, signal_time)""")
def covariate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel from its mirror image and one covariate, gated at 0.1: default model (signal_time -1) and masked ones of eight signal times."""
    out = _fits(spark, sf_dir, (0.5, 0.5, 0.6), 8, ["click"], folds=1, model="LinearRegression", mode="signal_masking", most=0.1)
    rows = out.filter("residual is not null").select("tx", "ty", F.coalesce("signal_time", F.lit(-1)).alias("signal_time"), (F.size("keys") > 0).alias("used"), F.posexplode("residual").alias("frame", "r"))
    return rows.select("tx", "ty", "signal_time", F.col("frame").cast("int").alias("frame"), "used", _r("r", 5).alias("residual"))


@query()
def trained_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each pixel by the default model and by those that fit the signal of four signal times, with all admissible covariates."""
    alphas = [0.1 * 1000 ** (k / 15) for k in range(16)]
    out = _fits(spark, sf_dir, (4.0, 3.0, 2.0), 4, "all", folds=3, model="RidgeCV", alphas=alphas, mode="signal_fitting", most=0.2)
    rms = F.sqrt(F.aggregate("residual", F.lit(0.0), lambda a, r: a + r * r) / F.size("residual"))
    return out.select("tx", "ty", "signal_time", F.round(rms, 6).alias("rms"), F.round("signal", 6).alias("signal"), F.size("px").alias("n_pixels"), F.size("keys").alias("n_covariates"))





@query()
def derotate_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over all frames turned back by cubic splines."""
    cube = src.dense_cube(spark, sf_dir)
    out = resample.derotated_cubic(cube, src.frames(cube), *grid(src.series(spark, sf_dir)))
    return out.groupBy("x", "y").agg(_r(F.avg("value")).alias("mean"))


@query(f"""WITH {CUBE}, {FRAMES}, {EXPECTED}, k AS (SELECT * FROM range(0, 11) a(i), range(0, 11) b(j)),
    psf AS (SELECT i, j, coalesce(v, 0) AS v FROM k LEFT JOIN (SELECT l_partkey % 11 AS i, l_suppkey % 11 AS j, avg(l_extendedprice) / 1e4 AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2) USING (i, j)),
    val AS (SELECT x, y, signal_time, frame, sum(v * greatest(0, 1 - abs(dx - ex + 5 - i)) * greatest(0, 1 - abs(dy - ey + 5 - j))) AS v FROM path, psf GROUP BY 1, 2, 3, 4),
    seen AS (SELECT x, y, signal_time, frame, CASE WHEN ex + sx / 2 - 0.5 BETWEEN 0 AND sx - 1 AND ey + sy / 2 - 0.5 BETWEEN 0 AND sy - 1 THEN v END AS v FROM val JOIN path USING (x, y, signal_time, frame), dim)
    SELECT x, y, signal_time, frame, round(v / max(v) OVER (PARTITION BY x, y, signal_time), 6) + 0.0 AS expected FROM seen""")
def template_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected signals of eight signal times from a template that is a table."""
    s = src.series(spark, sf_dir)
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(s)
    pixels = s.filter(masks.circle(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), 6.0))
    targets = pixels.select("dataset", F.col("x").alias("tx"), F.col("y").alias("ty")).join(ts.signal_times(cube.select("dataset", "frame"), 8), "dataset")
    templates = src.templates(spark, sf_dir).filter("dataset = 1").withColumn("dataset", F.lit("dense"))
    out = resample.template_series(targets, src.frames(cube), templates, sx, sy, 11, 11)
    return out.select(F.col("tx").alias("x"), F.col("ty").alias("y"), "signal_time", "frame", _r("expected").alias("expected"))


def _segment(c: str, r: float) -> str:
    return f"({c} * sqrt(greatest({r * r} - {c} * {c}, 0)) + {r * r} * asin({c} / {r}) + pi() * {r * r} / 2)"


def _area(x: str, y: str, r: float) -> str:
    x, y = (f"greatest(least({c}, {r}), -{r})" for c in (x, y))
    a, b = _segment(x, r), _segment(y, r)
    beyond = f"CASE WHEN {x} <= 0 AND {y} <= 0 THEN 0 WHEN {x} > 0 AND {y} > 0 THEN {a} + {b} - pi() * {r * r} WHEN {x} > 0 THEN {b} ELSE {a} END"
    return f"CASE WHEN {x} * {x} + {y} * {y} >= {r * r} THEN {beyond} ELSE {x} * {y} + ({a} + {b}) / 2 - pi() * {r * r} / 4 END"


@query(f"""WITH {CUBE}, {MAPS},
    pos AS (SELECT k, 5 * cos(radians(k * 60) + pi() / 2) + sx / 2 - 0.5 AS px, 5 * sin(radians(k * 60) + pi() / 2) + sy / 2 - 0.5 AS py FROM dim, range(0, 6) r(k)),
    c AS (SELECT map_id, k, value, x - px AS u, y - py AS w FROM maps, pos WHERE abs(x - px) < 3 AND abs(y - py) < 3)
    SELECT map_id, CAST(k AS INT) AS target, round(sum(value * (({_area('(u + 0.5)', '(w + 0.5)', 2.0)}) - ({_area('(u - 0.5)', '(w + 0.5)', 2.0)}) - ({_area('(u + 0.5)', '(w - 0.5)', 2.0)}) + ({_area('(u - 0.5)', '(w - 0.5)', 2.0)}))), 6) + 0.0 AS flux FROM c GROUP BY 1, 2""")
def exact_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluxes in circles, each pixel by its exact area inside."""
    maps = _maps(spark, sf_dir)
    sx, sy = grid(src.series(spark, sf_dir))
    px, py = fx.polar_to_cartesian(F.lit(5.0), F.radians(F.col("target") * 60), fx.center(sx), fx.center(sy))
    at = maps.select("map_id").distinct().withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("map_id", "target", px.alias("px"), py.alias("py"))
    return resample.exact_sums(maps, at, 2.0, ["map_id"], ["map_id", "target"]).select("map_id", "target", _r("flux").alias("flux"))
