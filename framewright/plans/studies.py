"""Queries over whole datasets: metadata and known sources, stellar fluxes, contrasts, hypothesis-based training, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import coords as fx
from framewright.operators import evaluate as ev
from framewright.operators import joins, models
from framewright.operators import series as ts
from framewright.plans.basic import CUBE, FRAMES, grid
from framewright.plans.detection import EXPECTED, MAPS, SHARE, SIGMA, STAMP, _expected, _maps, _r, _targets
from framewright.sources import tables as src

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


META = """meta AS (SELECT n_nationkey AS dataset, 0.2 + 0.01 * n_nationkey AS dit_stack, 0.05 AS dit_psf_template, 0.02 + 0.001 * (n_nationkey % 3) AS nd_filter FROM nation)"""
TARGETS = """targets AS (SELECT s_nationkey AS dataset, s_name AS name, 3 + s_suppkey % 5 AS sep, s_suppkey * 37 % 360 AS angle, 5 + s_suppkey % 4 AS contrast FROM supplier)"""
#: Flux of a source of contrast 0 over that of the template.
SCALE = "dit_stack::DOUBLE / dit_psf_template / nd_filter"


@query(f"""WITH {CUBE}, {META}, {TARGETS} SELECT dataset, name, round(sep * cos(radians(angle) + pi() / 2) + sx / 2 - 0.5, 6) AS x, round(sep * sin(radians(angle) + pi() / 2) + sy / 2 - 0.5, 6) AS y,
    round(pow(10, -contrast / 2.5) * {SCALE}, 6) AS scale FROM targets JOIN meta USING (dataset), dim""")
def target_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sources of every dataset: where they are in the first frame, and how bright against the template."""
    t = src.targets(spark, sf_dir).join(src.metadata(spark, sf_dir), "dataset")
    sx, sy = grid(src.series(spark, sf_dir))
    x, y = fx.polar_to_cartesian(F.col("separation") / F.col("pixscale"), F.radians("position_angle"), fx.center(sx), fx.center(sy))
    scale = fx.flux_ratio(F.col("contrast")) * F.col("dit_stack") / F.col("dit_psf_template") / F.col("nd_filter")
    return t.select("dataset", "name", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(scale, 6).alias("scale"))


@query(f"""WITH {CUBE}, {META}, {TARGETS}, night AS (SELECT CAST(frame // 8 AS INT) AS dataset, CAST(frame % 8 AS INT) AS frame, x, y, value FROM cube),
    psf AS (SELECT i AS tx, j AS ty, exp(-((i - 4) * (i - 4) + (j - 4) * (j - 4)) / (2 * {SIGMA} * {SIGMA})) AS tv FROM range(0, 9) a(i), range(0, 9) b(j)),
    pos AS (SELECT dataset, CAST(f AS INT) AS frame, sep * cos(radians(angle + 90 - (17.0 + f * (120.0 / 7)))) + sx / 2 - 0.5 AS px, sep * sin(radians(angle + 90 - (17.0 + f * (120.0 / 7)))) + sy / 2 - 0.5 AS py, pow(10, -contrast / 2.5) * {SCALE} AS scale
      FROM targets JOIN meta USING (dataset), range(0, 8) r(f), dim),
    c AS (SELECT dataset, frame, scale * tv AS v, px - 4 + tx AS u, py - 4 + ty AS w FROM pos, psf), k AS (SELECT * FROM range(0, 2) a(i), range(0, 2) b(j)),
    added AS (SELECT dataset, frame, CAST(floor(u) + i AS INT) AS x, CAST(floor(w) + j AS INT) AS y, sum(v * {SHARE.format(a='floor(u) + i', b='u')} * {SHARE.format(a='floor(w) + j', b='w')}) AS a FROM c, k GROUP BY 1, 2, 3, 4)
    SELECT n.dataset, n.frame, n.x, n.y, round(value - coalesce(a, 0), 6) + 0.0 AS value FROM night n LEFT JOIN added USING (dataset, frame, x, y)""")
def source_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eight frames as a dataset, all known sources of its target table taken out."""
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(src.series(spark, sf_dir))
    nights = cube.select(F.floor(F.col("frame") / 8).cast("int").alias("dataset"), (F.col("frame") % 8).cast("int").alias("frame"), "x", "y", "value")
    out = joins.without_sources(nights, src.frames(nights), src.gaussian_template(9, SIGMA), 9, src.targets(spark, sf_dir), src.metadata(spark, sf_dir), sx, sy)
    return out.select("dataset", "frame", "x", "y", _r("value").alias("value"))


STELLAR = f"""sub AS (SELECT (i + 0.5) / 10 - 0.5 AS u, (j + 0.5) / 10 - 0.5 AS w FROM range(0, 10) a(i), range(0, 10) b(j)),
    psf AS (SELECT l_linenumber AS dataset, l_partkey % 11 AS x, l_suppkey % 11 AS y, avg(l_extendedprice) / 1e4 AS v FROM lineitem GROUP BY 1, 2, 3),
    stellar AS (SELECT dataset, sum(v / 100 * {SCALE}) AS flux FROM psf JOIN meta USING (dataset), sub WHERE pow(x - 5 + u, 2) + pow(y - 5 + w, 2) <= 2.25 GROUP BY 1)"""


@query(f"WITH {META}, {STELLAR} SELECT CAST(dataset AS INT) AS dataset, round(flux, 3) AS flux FROM stellar")
def stellar_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.stellar_fluxes(src.templates(spark, sf_dir), src.metadata(spark, sf_dir), 1.5, 11, 11)
    return out.select("dataset", F.round("stellar_flux", 3).alias("flux"))


def _classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    sx, sy = grid(src.series(spark, sf_dir))
    baseline = src.dense_cube(spark, sf_dir).groupBy("x", "y").agg(F.avg("value").alias("value"))
    px, py = fx.polar_to_cartesian(F.col("sep"), F.radians("angle"), fx.center(sx), fx.center(sy))
    at = _targets(maps).select("map_id", "target", px.alias("px"), py.alias("py"))
    raw = ev.aperture_sums(ev.less_baseline(maps, baseline), at, 1.5, ["map_id"], ["map_id", "target"])
    star = ev.stellar_fluxes(src.templates(spark, sf_dir), src.metadata(spark, sf_dir), 1.5, 11, 11).withColumnRenamed("dataset", "map_id")
    rows = raw.withColumnRenamed("flux", "raw_flux").join(star, "map_id")
    return ev.contrasts(rows.withColumn("background_flux", F.lit(0.0)).withColumn("expected_contrast", 8.0 + F.col("target")))


@query(f"""WITH {CUBE}, {MAPS}, {META}, {STELLAR}, base AS (SELECT x, y, avg(value) AS b FROM cube GROUP BY 1, 2),
    pos AS (SELECT CAST(k AS INT) AS target, (5 + k) * cos(radians(40 * k) + pi() / 2) + sx / 2 - 0.5 AS px, (5 + k) * sin(radians(40 * k) + pi() / 2) + sy / 2 - 0.5 AS py FROM dim, range(0, 3) r(k)),
    fl AS (SELECT map_id, target, sum((value - b) / 100) AS raw FROM maps JOIN base USING (x, y), pos, sub WHERE abs(x - px) <= 3 AND abs(y - py) <= 3 AND pow(x - px + u, 2) + pow(y - py + w, 2) <= 2.25 GROUP BY 1, 2),
    q AS (SELECT map_id, target, raw / flux AS ratio FROM fl JOIN stellar ON dataset = map_id)
    SELECT map_id, target, round(ratio, 9) + 0.0 AS ratio, CASE WHEN ratio > 1e-8 THEN round(-2.5 * log10(ratio), 4) END AS contrast, round(greatest(ratio / pow(10, -(8 + target) / 2.5), 0), 5) AS throughput FROM q""")
def classic_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of each target against the star, on the maps less the map without sources."""
    c = _classic(spark, sf_dir)
    finite = F.when(F.col("observed_contrast") < float("inf"), F.round("observed_contrast", 4))
    return c.select("map_id", "target", _r("observed_flux_ratio", 9).alias("ratio"), finite.alias("contrast"), F.round("throughput", 5).alias("throughput"))


@query()
def batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast, throughput and metrics of every experiment that has a map, in order of contrast, separation and position."""
    maps = _maps(spark, sf_dir)
    sx, sy = grid(src.series(spark, sf_dir))
    t = _targets(maps)
    tests = ev.summary(ev.with_fpf(ev.target_metrics(maps, t, sx / 2 - 0.5, sy / 2 - 0.5, 1.5)), ["map_id", "target"], ["snr", "log_fpf"])
    out = _classic(spark, sf_dir).select("map_id", "target", "expected_contrast", "observed_contrast", "throughput").join(tests, ["map_id", "target"]).join(t, ["map_id", "target"])
    return out.orderBy("sep", "expected_contrast", "angle", "map_id")


@query(f"""WITH {CUBE}, {FRAMES}, {EXPECTED}, oc AS (SELECT CAST(event_id % 64 AS INT) AS frame, event_type AS key, avg(CAST(value AS DOUBLE)) AS o FROM events GROUP BY 1, 2),
    g AS (SELECT x, y, signal_time, key, count(*) > count(expected) AS gap, min(expected) = max(expected) AS flat, CASE WHEN stddev_pop(CASE WHEN expected IS NOT NULL THEN o END) > 0 AND stddev_pop(expected) > 0 THEN corr(expected, o) END AS r FROM expected JOIN oc USING (frame) GROUP BY 1, 2, 3, 4)
    SELECT x, y, signal_time, key, round(r, 5) AS r FROM g WHERE gap OR flat OR abs(r) <= 0.2""")
def covariates_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates that may serve as predictors of each pixel and signal time."""
    out = ts.admissible_covariates(_expected(spark, sf_dir), src.covariates(spark, sf_dir), 0.2)
    return out.select("x", "y", "signal_time", "key", F.round("r", 5).alias("r"))


@query(f"""WITH {CUBE}, {FRAMES}, {STAMP}, e AS (SELECT frame, x, y, coalesce(a, 0) / (SELECT max(a) FROM added) AS e FROM cube LEFT JOIN added USING (frame, x, y)),
    o AS (SELECT a.x AS tx, a.y AS ty, a.frame, a.value AS v, b.value AS p, e FROM cube a JOIN e USING (frame, x, y), cube b, dim WHERE b.frame = a.frame AND b.x = sx - 1 - a.x AND b.y = sy - 1 - a.y),
    m AS (SELECT tx, ty, max(e) > 0.2 AS hit, avg(v) AS mv, avg(p) AS mp, avg(e) AS me, var_pop(p) AS pp, var_pop(e) AS ee, covar_pop(p, e) AS pe, covar_pop(p, v) AS pv, covar_pop(e, v) AS ev FROM o GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN hit THEN (ev * pp - pv * pe) / (pp * ee - pe * pe) END AS ce FROM m),
    f AS (SELECT tx, ty, mv, mp, me, CASE WHEN ce >= 0 THEN (pv * ee - ev * pe) / (pp * ee - pe * pe) ELSE pv / pp END AS slope, CASE WHEN ce >= 0 THEN ce ELSE 0 END AS share FROM c)
    SELECT tx, ty, frame, round(v - mv - slope * (p - mp) + share * me, 5) + 0.0 AS residual FROM o JOIN f USING (tx, ty)""")
def hypothesis_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per pixel under a hypothesis: with the expected signal where the source passes, without elsewhere."""
    s = src.series(spark, sf_dir)
    sx, sy = grid(s)
    cube = src.dense_cube(spark, sf_dir)
    overlay, _ = joins.injected(cube.withColumn("value", F.lit(0.0)), src.frames(cube), src.gaussian_template(9, SIGMA), 9, 6.0, 45.0, 0.0, sx, sy)
    pairs = s.select(F.col("x").alias("tx"), F.col("y").alias("ty"), (sx - 1 - F.col("x")).cast("int").alias("x"), (sy - 1 - F.col("y")).cast("int").alias("y"))
    out = models.fit_pixels(pairs, s, models.expected_of_overlay(overlay), folds=1, model="LinearRegression", mode="signal_fitting")
    return out.select("tx", "ty", F.posexplode("residual").alias("frame", "r")).select("tx", "ty", F.col("frame").cast("int").alias("frame"), _r("r", 5).alias("residual"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS injection_k, event_type AS injection_kind, 2 * CAST(json_extract(props, '$.k') AS INT) AS injection_place_sep, CAST(value AS DOUBLE) AS contrast FROM events""")
def flattened_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested settings with one set anew, and all of them as flat columns."""
    e = src.table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.from_json("props", "k int").alias("p"))
    place = F.struct(F.lit(None).cast("int").alias("sep"))
    nested = e.select("event_id", F.struct(F.struct("p.k", F.col("event_type").alias("kind"), place.alias("place")).alias("injection"), F.col("value").alias("contrast")).alias("config"), "p")
    done = nested.withColumn("config", fx.with_setting(F.col("config"), "injection.place.sep", 2 * F.col("p.k")))
    return done.select("event_id", *fx.flattened("config", done.schema["config"].dataType))


@query(f"""WITH {META}, {TARGETS}, cube AS (SELECT l_linenumber AS dataset, l_orderkey % 24 AS frame, l_partkey % 11 AS x, l_suppkey % 11 AS y FROM lineitem),
    c AS (SELECT dataset, count(DISTINCT frame) AS n_frames, CAST(max(x) + 1 AS INT) AS size_x, CAST(max(y) + 1 AS INT) AS size_y, max(frame) + 1 AS n_angles FROM cube GROUP BY 1),
    o AS (SELECT user_id % 7 + 1 AS dataset, count(DISTINCT event_type) AS n FROM events GROUP BY 1), p AS (SELECT dataset, count(DISTINCT x * 11 + y) AS n FROM cube GROUP BY 1), t AS (SELECT dataset, count(*) AS n FROM targets GROUP BY 1)
    SELECT CAST(c.dataset AS INT) AS dataset, n_frames, size_x, size_y, n_angles, CAST(120 AS DOUBLE) AS field, coalesce(o.n, 0) AS n_covariates, coalesce(p.n, 0) AS n_template, CASE WHEN c.dataset IN (SELECT dataset FROM meta) THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_metadata,
      coalesce(t.n, 0) AS n_targets, n_angles = n_frames AND p.n > 0 AND c.dataset IN (SELECT dataset FROM meta) AS complete
    FROM c LEFT JOIN o USING (dataset) LEFT JOIN p USING (dataset) LEFT JOIN t USING (dataset)""")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line number as a dataset of its own: what of its parts is there."""
    rows = src.table(spark, sf_dir, "lineitem")
    cell = [(F.col(c) % n).cast("int").alias(a) for c, n, a in (("l_orderkey", 24, "frame"), ("l_partkey", 11, "x"), ("l_suppkey", 11, "y"))]
    cube = rows.select(F.col("l_linenumber").cast("int").alias("dataset"), *cell)
    events = src.table(spark, sf_dir, "events").select((F.col("user_id") % 7 + 1).cast("int").alias("dataset"), F.col("event_type").alias("key"))
    out = src.manifest(cube, src.frames(cube), events, src.templates(spark, sf_dir), src.metadata(spark, sf_dir), src.targets(spark, sf_dir))
    return out.withColumn("field", F.round("field", 6))
