"""Whole searches composed of the operators: bundles, selection masks, signal maps, contrasts."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import coords as fx
from framewright.operators import evaluate as ev
from framewright.operators import joins, masks, models
from framewright.operators import series as ts
from framewright.plans.basic import CUBE, FRAMES, grid
from framewright.plans.detection import MAPS, RING, SHARE, SIGMA, _maps, _r, _targets
from framewright.plans.studies import META, SCALE, TARGETS
from framewright.sources import tables as src

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Dataset(NamedTuple):
    cube: DataFrame
    frames: DataFrame
    obscon: DataFrame
    psf: DataFrame
    metadata: DataFrame


def load_dataset(spark: SparkSession, sf_dir: str, binning: int = 1, crop: tuple[int, int] = (-1, -1), without_targets: bool = False) -> Dataset:
    """Cube, angles, covariates, template and metadata of the item cube: cropped in the scan, then known sources taken out, then binned, all lazily.

    The item cube has the metadata and the sources of nation 3 and the template of line number 1.
    """
    named = lambda df, k: df.filter(F.col("dataset") == k).withColumn("dataset", F.lit("items"))
    cube = src.item_cube(spark, sf_dir)
    frames = src.frames(cube.select("dataset", "frame"))
    sizes = {"x": 11, "y": 11}
    cube = masks.cropped(cube, sizes, {"x": crop[0], "y": crop[1]})
    metadata = named(src.metadata(spark, sf_dir), 3)
    if without_targets:
        sx, sy = (c if 0 < c <= 11 else 11 for c in crop)
        cube = joins.without_sources(cube, frames, src.gaussian_template(9, SIGMA), 9, named(src.targets(spark, sf_dir), 3), metadata, sx, sy)
    obscon = src.obscon(spark, sf_dir)
    if binning != 1:
        cube, frames, obscon = ts.binned(cube, binning, ["dataset", "x", "y"]), ts.binned(frames, binning, ["dataset"], "parang"), ts.binned(obscon, binning, ["dataset", "key"])
    return Dataset(cube, frames, obscon, src.one_template(named(src.templates(spark, sf_dir), 1)), metadata)


@query(f"""WITH {META}, {TARGETS}, items AS (SELECT CAST(l_orderkey % 24 AS INT) AS frame, CAST(l_partkey % 11 AS INT) AS x, CAST(l_suppkey % 11 AS INT) AS y, avg(ln(l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2, 3),
    last AS (SELECT max(frame) AS m FROM items), fr AS (SELECT CAST(k AS INT) AS frame, 17.0::DOUBLE + k * (120.0::DOUBLE / m) AS parang FROM last, range(0, m + 1) r(k)),
    crop AS (SELECT frame, x - 2 AS x, y - 1 AS y, value FROM items WHERE x BETWEEN 2 AND 8 AND y BETWEEN 1 AND 9),
    tg AS (SELECT sep, angle, pow(10, -contrast / 2.5) * {SCALE} AS scale FROM targets JOIN meta USING (dataset) WHERE dataset = 3),
    pos AS (SELECT frame, sep * cos(radians(angle + 90 - parang)) + 3 AS px, sep * sin(radians(angle + 90 - parang)) + 4 AS py, scale FROM tg, fr),
    psf AS (SELECT i AS tx, j AS ty, exp(-((i - 4) * (i - 4) + (j - 4) * (j - 4)) / (2 * {SIGMA} * {SIGMA})) AS tv FROM range(0, 9) a(i), range(0, 9) b(j)),
    added AS (SELECT c.frame, c.x, c.y, sum(scale * tv * {SHARE.format(a='px - 4 + tx', b='c.x')} * {SHARE.format(a='py - 4 + ty', b='c.y')}) AS a FROM crop c JOIN pos USING (frame), psf WHERE abs(px - 4 + tx - c.x) < 1 AND abs(py - 4 + ty - c.y) < 1 GROUP BY 1, 2, 3),
    b AS (SELECT frame // 3 AS f, x, y, avg(value - coalesce(a, 0)) AS v FROM crop LEFT JOIN added USING (frame, x, y) GROUP BY 1, 2, 3), an AS (SELECT frame // 3 AS f, avg(parang) AS p FROM fr GROUP BY 1),
    oc AS (SELECT frame // 3 AS f, avg(o) AS o FROM (SELECT CAST(hour(ts) AS INT) AS frame, avg(CAST(value AS DOUBLE)) AS o FROM events WHERE event_type = 'click' GROUP BY 1) GROUP BY 1)
    SELECT CAST(f AS INT) AS frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(v, 6) + 0.0 AS value, round(p, 6) AS parang, round(o, 6) AS covariate, round(0.2 + 0.03, 6)::DOUBLE AS dit FROM b JOIN an USING (f) JOIN oc USING (f)""")
def loaded_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bundle, cropped, without its known sources and binned; one covariate and the metadata beside each cell."""
    d = load_dataset(spark, sf_dir, 3, (7, 9), without_targets=True)
    one = d.obscon.filter("key = 'click'").select("dataset", "frame", F.col("value").alias("covariate"))
    rows = d.cube.join(d.frames, ["dataset", "frame"]).join(one, ["dataset", "frame"]).join(d.metadata.select("dataset", "dit_stack"), "dataset")
    return rows.select("frame", "x", "y", _r("value").alias("value"), F.round("parang", 6).alias("parang"), F.round("covariate", 6).alias("covariate"), F.round("dit_stack", 6).alias("dit"))


@query("""SELECT l_returnflag AS method, CAST(pow(2, l_linenumber) AS INT) AS factor, round(median(l_discount), 6) AS score, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""")
def scores_by_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two methods in order of their binning factors."""
    rows = src.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("method"), F.pow(F.lit(2), "l_linenumber").cast("int").alias("factor"), "l_discount")
    return rows.groupBy("method", "factor").agg(F.round(F.median("l_discount"), 6).alias("score"), F.count("*").alias("n")).orderBy("method", "factor")


@query("""WITH items AS (SELECT CAST(l_partkey % 11 AS INT) AS x, CAST(l_suppkey % 11 AS INT) AS y, avg(ln(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2)
    SELECT 'cropped' AS kind, x - 2 AS x, y - 3 AS y, round(v, 6) AS value FROM items WHERE x BETWEEN 2 AND 8 AND y BETWEEN 3 AND 7
    UNION ALL SELECT 'padded', CAST(i AS INT), CAST(j AS INT), round(coalesce(v, 0), 6) FROM range(0, 15) a(i), range(0, 12) b(j) LEFT JOIN items ON x + 2 = i AND y = j""")
def cropped_or_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map brought to a smaller and to a larger size by the same operator."""
    m = src.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 11).cast("int").alias("x"), (F.col("l_suppkey") % 11).cast("int").alias("y")).agg(F.avg(F.log("l_extendedprice")).alias("value")).withColumn("dataset", F.lit("items"))
    sizes = {"x": 11, "y": 11}
    both = [masks.crop_or_pad(m, sizes, wanted, ["dataset"]).select(F.lit(kind).alias("kind"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.round("value", 6).alias("value")) for kind, wanted in (("cropped", {"x": 7, "y": 5}), ("padded", {"x": 15, "y": 12}))]
    return both[0].unionByName(both[1])


@query("""WITH items AS (SELECT CAST(l_orderkey % 24 AS INT) AS frame, CAST(l_partkey % 11 AS INT) AS x, CAST(l_suppkey % 11 AS INT) AS y, avg(ln(l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2, 3),
    b AS (SELECT frame // 3 AS f, x - 2 AS x, y - 1 AS y, avg(value) AS v FROM items WHERE x BETWEEN 2 AND 8 AND y BETWEEN 1 AND 9 GROUP BY 1, 2, 3),
    last AS (SELECT max(frame) AS m FROM items), a AS (SELECT k // 3 AS f, avg(17.0 + k * (CAST(120.0 AS DOUBLE) / m)) AS parang FROM last, range(0, m + 1) r(k) GROUP BY 1)
    SELECT CAST(b.f AS INT) AS frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(v, 6) AS value, round(parang, 6) AS parang FROM b JOIN a USING (f)""")
def binned_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load_dataset(spark, sf_dir, 3, (7, 9))
    return d.cube.join(d.frames, ["dataset", "frame"]).select("frame", "x", "y", F.round("value", 6).alias("value"), F.round("parang", 6).alias("parang"))


@query(f"""WITH {CUBE}, {MAPS}, w AS (SELECT map_id, x, y, value, 1 + x AS contrast FROM maps)
    SELECT map_id, x, y, round(value / 5, 6) + 0.0 AS ratio, CASE WHEN value / 5 > 1e-8 THEN round(-2.5 * log10(value / 5), 5) END AS contrast,
      round(greatest(value / 5 / pow(10, -contrast / 2.5), 0), 5) AS throughput FROM w""")
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _maps(spark, sf_dir).select("map_id", "x", "y", F.col("value").alias("raw_flux"), F.lit(0.0).alias("background_flux"), F.lit(5.0).alias("stellar_flux"), (1.0 + F.col("x")).alias("expected_contrast"))
    c = ev.contrasts(rows)
    return c.select("map_id", "x", "y", _r("observed_flux_ratio").alias("ratio"), F.when(F.col("observed_contrast") < float("inf"), F.round("observed_contrast", 5)).alias("contrast"), F.round("throughput", 5).alias("throughput"))


RINGED = f"""sub AS (SELECT (i + 0.5) / 10 - 0.5 AS u, (j + 0.5) / 10 - 0.5 AS w FROM range(0, 10) a(i), range(0, 10) b(j)),
    spot AS (SELECT map_id, target, TRUE AS own, 0 AS i, sep, angle FROM tg UNION ALL SELECT map_id, target, FALSE, i, sep, ref_angle FROM ring),
    spots AS (SELECT map_id, target, own, i, sep * cos(radians(angle) + pi() / 2) + sx / 2 - 0.5 AS px, sep * sin(radians(angle) + pi() / 2) + sy / 2 - 0.5 AS py FROM spot, dim),
    flux AS (SELECT s.map_id, target, own, s.i, sum(CASE WHEN pow(x - px + u, 2) + pow(y - py + w, 2) <= 2.25 THEN value / 100 ELSE 0 END) AS f FROM spots s JOIN maps m ON m.map_id = s.map_id AND abs(x - px) < 2.5 AND abs(y - py) < 2.5, sub GROUP BY 1, 2, 3, 4),
    less AS (SELECT map_id, target, max(f) FILTER (own) - median(f) FILTER (NOT own) AS f FROM flux GROUP BY 1, 2)"""


@query(f"""WITH {CUBE}, {MAPS}, {RING}, {RINGED}, q AS (SELECT map_id, target, f / (2 * pi() * 10 * {SIGMA * SIGMA} * (1 - exp(-2.25 / (2 * {SIGMA * SIGMA})))) AS ratio FROM less)
    SELECT map_id, CAST(target AS INT) AS target, round(ratio, 6) + 0.0 AS ratio, CASE WHEN ratio > 1e-8 THEN round(-2.5 * log10(ratio), 5) END AS contrast, round(greatest(ratio / pow(10, -5.0 / 2.5), 0), 5) AS throughput FROM q""")
def target_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux at each target less the median of its ring, over a stellar flux of the template, for every map at once."""
    rows = _above_ring(spark, sf_dir).withColumn("stellar_flux", fx.gaussian_integral(F.lit(10.0), F.lit(SIGMA), 1.5)).withColumn("expected_contrast", F.lit(5.0))
    c = ev.contrasts(rows)
    finite = F.when(F.col("observed_contrast") < float("inf"), F.round("observed_contrast", 5))
    return c.select("map_id", "target", _r("observed_flux_ratio").alias("ratio"), finite.alias("contrast"), F.round("throughput", 5).alias("throughput"))


@query(f"""WITH {CUBE}, {MAPS}, {RING}, {RINGED}, {META}, psf AS (SELECT l_linenumber AS dataset, l_partkey % 11 AS x, l_suppkey % 11 AS y, avg(l_extendedprice) / 1e4 AS v FROM lineitem GROUP BY 1, 2, 3),
    stellar AS (SELECT dataset, sum(v / 100 * {SCALE}) AS flux FROM psf JOIN meta USING (dataset), sub WHERE pow(x - 5 + u, 2) + pow(y - 5 + w, 2) <= 2.25 GROUP BY 1),
    q AS (SELECT map_id, target, f / flux AS ratio FROM less JOIN stellar ON dataset = map_id)
    SELECT map_id, CAST(target AS INT) AS target, round(ratio, 9) + 0.0 AS ratio, CASE WHEN ratio > 1e-8 THEN round(-2.5 * log10(ratio), 4) END AS contrast, round(greatest(ratio / pow(10, -(8 + target) / 2.5), 0), 5) AS throughput FROM q""")
def ring_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of each target against the star of its dataset's own template: the background is the median of the ring."""
    star = ev.stellar_fluxes(src.templates(spark, sf_dir), src.metadata(spark, sf_dir), 1.5, 11, 11).withColumnRenamed("dataset", "map_id")
    c = ev.contrasts(_above_ring(spark, sf_dir).join(star, "map_id").withColumn("expected_contrast", 8.0 + F.col("target")))
    finite = F.when(F.col("observed_contrast") < float("inf"), F.round("observed_contrast", 4))
    return c.select("map_id", "target", _r("observed_flux_ratio", 9).alias("ratio"), finite.alias("contrast"), F.round("throughput", 5).alias("throughput"))


def _above_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, target, raw_flux, background_flux): flux at each target and the median flux on its ring."""
    maps = _maps(spark, sf_dir)
    sx, sy = grid(src.series(spark, sf_dir))

    def place(df: DataFrame, angle: str) -> DataFrame:
        px, py = fx.polar_to_cartesian(F.col("sep"), F.radians(angle), fx.center(sx), fx.center(sy))
        return df.withColumn("px", px).withColumn("py", py)

    t = _targets(maps)
    raw = ev.aperture_sums(maps, place(t, "angle").select("map_id", "target", "px", "py"), 1.5, ["map_id"], ["map_id", "target"])
    ring = place(joins.ring_positions(t, 1.5), "ref_angle").select("map_id", "target", "i", "px", "py")
    back = ev.aperture_sums(maps, ring, 1.5, ["map_id"], ["map_id", "target", "i"]).groupBy("map_id", "target").agg(F.median("flux").alias("background_flux"))
    return raw.withColumnRenamed("flux", "raw_flux").join(back, ["map_id", "target"])


@query()
def selection_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels along the arcs of candidates: polar map, edge weight, template match, local maxima, pruning, stamped arcs."""
    maps = _maps(spark, sf_dir)
    sx, sy = grid(maps)
    n = 32
    polar = joins.sampled(maps, joins.polar_points(maps, ["map_id"], n, sx, sy), ["map_id"], ["map_id", "r", "p"])
    polar = polar.withColumn("value", F.col("value") * masks.radial_weight(F.col("r"), n, min(sx, sy)))
    stamp = spark.range(1).select(F.explode(src.gaussian_template(5, SIGMA)).alias("c")).select((F.col("c.tx") - 2).alias("dr"), (F.col("c.ty") - 2).alias("dp"), F.col("c.tv").alias("t"))
    score = joins.template_match(polar, stamp, n, ["map_id"])
    peaks = ev.local_maxima(score.withColumnsRenamed({"r": "x", "p": "y"})).filter("value > 0.5").withColumnsRenamed({"x": "r", "y": "p"})
    reach = min(sx, sy) / 2
    kept = masks.without_weaker_neighbours(peaks.select("map_id", "r", "p", F.col("value").alias("brightness")))
    at = kept.select("map_id", (F.col("r") * (reach / n)).alias("sep"), F.degrees(F.col("p") * (2 * math.pi / n)).alias("angle"))
    arcs = joins.arc_cells(at, 40.0, ["map_id"], sx, sy, src.gaussian_template(9, SIGMA), 9)
    share = F.col("value") / F.max("value").over(Window.partitionBy("map_id"))
    return arcs.withColumn("share", share).filter("share > 0.1").select("map_id", "x", "y", F.round("share", 6).alias("share"))


@query(f"""WITH {CUBE}, {FRAMES}, psf AS (SELECT i AS tx, j AS ty, exp(-((i - 4) * (i - 4) + (j - 4) * (j - 4)) / (2 * {SIGMA} * {SIGMA})) AS tv FROM range(0, 9) a(i), range(0, 9) b(j)),
    pos AS (SELECT frame, 5 * cos(radians(45 + 90 - parang)) + sx / 2 - 0.5 AS px, 5 * sin(radians(45 + 90 - parang)) + sy / 2 - 0.5 AS py FROM frames, dim),
    added AS (SELECT c.frame, c.x, c.y, sum(tv * {SHARE.format(a='px - 4 + tx', b='c.x')} * {SHARE.format(a='py - 4 + ty', b='c.y')}) AS a FROM cube c JOIN pos USING (frame), psf WHERE abs(px - 4 + tx - c.x) < 1 AND abs(py - 4 + ty - c.y) < 1 GROUP BY 1, 2, 3),
    lit AS (SELECT frame, x, y, value + coalesce(a, 0) AS v FROM cube LEFT JOIN added USING (frame, x, y)), d AS (SELECT frame, i - 4 AS dx, j - 4 AS dy, px + i - 4 AS qx, py + j - 4 AS qy FROM pos, range(0, 9) a(i), range(0, 9) b(j)), k AS (SELECT * FROM range(0, 2) a(i), range(0, 2) b(j)),
    s AS (SELECT d.frame, dx, dy, sum(coalesce(v, 0) * {SHARE.format(a='floor(qx) + i', b='qx')} * {SHARE.format(a='floor(qy) + j', b='qy')}) AS v FROM d CROSS JOIN k LEFT JOIN lit l ON l.frame = d.frame AND l.x = floor(qx) + i AND l.y = floor(qy) + j GROUP BY 1, 2, 3)
    SELECT CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, round(median(v), 6) + 0.0 AS value FROM s GROUP BY 1, 2""")
def median_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over frames of the window around an injected source that moves with the angles."""
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(cube)
    out, at = joins.injected(cube, src.frames(cube), src.gaussian_template(9, SIGMA), 9, 5.0, 45.0, 0.0, sx, sy)
    p = joins.patches(out, at, 4)
    return p.groupBy("dx", "dy").agg(_r(F.median("value")).alias("value"))


@query()
def signal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cube to signal map: bins, region, predictors, leave-fold-out fits, derotation, mean."""
    cube = ts.binned(src.dense_cube(spark, sf_dir), 2, ["dataset", "x", "y"])
    sx, sy = grid(cube)
    s = cube.groupBy("dataset", "x", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda p: p["value"]).alias("v"))
    inside = masks.circle(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), 8.0)
    targets = s.filter(inside).select("dataset", F.col("x").alias("tx"), F.col("y").alias("ty"))
    pairs = joins.predictor_pairs(targets, s.select("dataset", "x", "y"), sx, sy, 4.0, 3.0, 2.0, ["dataset"])
    fits = models.fit_pixels(pairs, s, folds=3, model="Ridge", alphas=[1.0])
    residual = fits.select(F.lit("dense").alias("dataset"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.posexplode("residual").alias("frame", "value"))
    turned = joins.derotated(residual, src.frames(cube.select("dataset", "frame")), sx, sy)
    return turned.groupBy("x", "y").agg(_r(F.avg("value")).alias("signal"))
