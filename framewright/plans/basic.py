"""Queries over scans, masks, binning, correlations and joins of the cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import coords as fx
from framewright.operators import joins, masks
from framewright.operators import series as ts
from framewright.sources import tables as src

QUERIES, ORACLES = {}, {}

#: The dense cube, its grid size, its angles, the item cube and the covariates, in SQL.
CUBE = """cube AS (SELECT CAST(vec_id % 25 AS INT) AS x, CAST(vec_id // 25 AS INT) AS y,
    CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS frame, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
  dim AS (SELECT 25 AS sx, max(y) + 1 AS sy, max(frame) AS last FROM cube)"""
FRAMES = "frames AS (SELECT CAST(f AS INT) AS frame, 17.0 + f * (CAST(120.0 AS DOUBLE) / last) AS parang FROM dim, range(0, last + 1) r(f))"
ITEMS = """items AS (SELECT CAST(l_orderkey % 24 AS INT) AS frame, CAST(l_partkey % 11 AS INT) AS x, CAST(l_suppkey % 11 AS INT) AS y,
    avg(ln(l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2, 3)"""
OBSCON = "obscon AS (SELECT CAST(hour(ts) AS INT) AS frame, event_type AS key, avg(CAST(value AS DOUBLE)) AS value FROM events GROUP BY 1, 2)"
CENTRE = "(x - (sx / 2 - 0.5)) * (x - (sx / 2 - 0.5)) + (y - (sy / 2 - 0.5)) * (y - (sy / 2 - 0.5))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def grid(cube: DataFrame) -> tuple[int, int]:
    """Size of the frames: two numbers."""
    r = cube.agg(F.max("x"), F.max("y")).first()
    return int(r[0]) + 1, int(r[1]) + 1


@query(f"WITH {CUBE} SELECT x, y, CAST(frame // 4 AS INT) AS frame, round(avg(value), 6) AS value FROM cube GROUP BY 1, 2, 3")
def bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.binned(src.dense_cube(spark, sf_dir), 4, ["x", "y"])
    return out.select("x", "y", "frame", F.round("value", 6).alias("value"))


@query(f"WITH {ITEMS} SELECT x, y, CAST(frame // 5 AS INT) AS frame, round(median(value), 4) AS value FROM items GROUP BY 1, 2, 3")
def bin_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.binned(src.item_cube(spark, sf_dir), 5, ["x", "y"], how=F.median)
    return out.select("x", "y", "frame", F.round("value", 4).alias("value"))


@query(f"""WITH {CUBE}, c AS (SELECT *, sx // 2 - 5 AS x0, sy // 2 - 4 AS y0 FROM cube, dim)
    SELECT CAST(x - x0 AS INT) AS x, CAST(y - y0 AS INT) AS y, frame, round(value, 6) AS value FROM c WHERE x BETWEEN x0 AND x0 + 10 AND y BETWEEN y0 AND y0 + 8""")
def crop_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(cube)
    out = masks.cropped(cube, {"x": sx, "y": sy}, {"x": 11, "y": 9})
    return out.select("x", "y", "frame", F.round("value", 6).alias("value"))


@query(f"""WITH {ITEMS}, m AS (SELECT x, y, avg(value) AS v FROM items GROUP BY 1, 2)
    SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, round(coalesce(v, -1), 4) AS value FROM range(0, 16) a(i), range(0, 13) b(j) LEFT JOIN m ON x + 2 = i AND y + 1 = j""")
def pad_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.item_cube(spark, sf_dir).groupBy("dataset", "x", "y").agg(F.avg("value").alias("value"))
    out = masks.padded(m, {"x": 11, "y": 11}, {"x": 16, "y": 13}, ["dataset"], -1.0)
    return out.select(F.col("x").cast("int"), F.col("y").cast("int"), F.round("value", 4).alias("value"))


@query(f"WITH {CUBE} SELECT DISTINCT x, y FROM cube, dim WHERE ({CENTRE} < 64) <> ({CENTRE} < 9)")
def roi_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = src.series(spark, sf_dir).select("x", "y")
    return pixels.filter(masks.roi(*grid(pixels), 3.0, 8.0)).orderBy("x", "y")


@query(f"""WITH {CUBE}, p AS (SELECT DISTINCT x, y FROM cube, dim WHERE ({CENTRE} < 64) <> ({CENTRE} < 9))
    SELECT x, y, CAST((row_number() OVER (ORDER BY x, y) - 1) % 4 AS INT) AS split FROM p""")
def roi_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.series(spark, sf_dir).select("dataset", "x", "y")
    return masks.split_of(rows.filter(masks.roi(*grid(rows), 3.0, 8.0)), 4, ["dataset"]).select("x", "y", "split")


@query(f"""WITH {CUBE}, p AS (SELECT DISTINCT x, y FROM cube), a AS (SELECT x, y FROM p, dim WHERE {CENTRE} < 36),
      b AS (SELECT x, y FROM p, dim WHERE (x - 5) * (x - 5) + (y - 5) * (y - 5) < 30)
    SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
    UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'one of them', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = src.series(spark, sf_dir).select("x", "y")
    sx, sy = grid(pixels)
    x, y = F.col("x"), F.col("y")
    a = masks.circle(x, y, fx.center(sx), fx.center(sy), 6.0)
    b = (x - 5) * (x - 5) + (y - 5) * (y - 5) < 30
    flags = [("both", a & b), ("either", a | b), ("first only", a & ~b), ("one of them", a != b)]
    found = pixels.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), f.alias("hit")) for n, f in flags])).alias("f"))
    return found.groupBy("f.part").agg(F.sum(F.col("f.hit").cast("long")).alias("n"))


PREDICTORS = """p AS (SELECT DISTINCT x, y FROM cube), t AS (SELECT x AS tx, y AS ty FROM p, dim WHERE (x - (sx / 2 - 0.5)) * (x - (sx / 2 - 0.5)) + (y - (sy / 2 - 0.5)) * (y - (sy / 2 - 0.5)) < 81),
  pairs AS (SELECT tx, ty, x, y FROM t, p, dim WHERE ((x - tx) * (x - tx) + (y - ty) * (y - ty) < 16
     OR (x - (sx - 1 - tx)) * (x - (sx - 1 - tx)) + (y - (sy - 1 - ty)) * (y - (sy - 1 - ty)) < 9) AND NOT ((x - tx) * (x - tx) + (y - ty) * (y - ty) < 4))"""


def _pairs(pixels: DataFrame, sx: int, sy: int, radius: float = 9.0) -> DataFrame:
    inside = masks.circle(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), radius)
    targets = pixels.filter(inside).select("dataset", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return joins.predictor_pairs(targets, pixels, sx, sy, 4.0, 3.0, 2.0, ["dataset"])


@query(f"WITH {CUBE}, {PREDICTORS} SELECT tx, ty, x, y FROM pairs")
def predictor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = src.series(spark, sf_dir).select("dataset", "x", "y")
    return _pairs(pixels, *grid(pixels)).select("tx", "ty", "x", "y")


CORR = "(avg({a} * {b}) - avg({a}) * avg({b})) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query(f"""WITH {CUBE}, {PREDICTORS}, bins AS (SELECT x, y, frame // 2 AS frame, avg(value) AS value FROM cube GROUP BY 1, 2, 3),
    c AS (SELECT tx, ty, p.x, p.y, round({CORR.format(a='a.value', b='b.value')}, 6) AS r FROM pairs p
      JOIN bins a ON a.x = tx AND a.y = ty JOIN bins b ON b.x = p.x AND b.y = p.y AND a.frame = b.frame GROUP BY 1, 2, 3, 4)
    SELECT tx, ty, x, y, r FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty ORDER BY r DESC, x, y) AS k FROM c) WHERE k = 1""")
def top_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin, cut to the region, join each pixel to its predictors, correlate and keep the best."""
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(cube)
    bins = ts.binned(cube, 2, ["dataset", "x", "y"])
    pairs = _pairs(src.series(spark, sf_dir).select("dataset", "x", "y"), sx, sy)
    a = bins.select("dataset", F.col("x").alias("tx"), F.col("y").alias("ty"), "frame", F.col("value").alias("a"))
    b = bins.select("dataset", "x", "y", "frame", F.col("value").alias("b"))
    met = pairs.join(a, ["dataset", "tx", "ty"]).join(b, ["dataset", "x", "y", "frame"])
    r = met.groupBy("tx", "ty", "x", "y").agg(F.round(ts.pearson(F.col("a"), F.col("b")), 6).alias("r"))
    best = Window.partitionBy("tx", "ty").orderBy(F.desc("r"), "x", "y")
    return r.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")


@query(f"""WITH {CUBE} SELECT a.x, a.y, round(sum(a.value * b.value), 6) AS product FROM cube a, cube b, dim
    WHERE a.frame = b.frame AND b.x = sx - 1 - a.x AND b.y = sy - 1 - a.y GROUP BY 1, 2""")
def mirror_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    both = joins.mirrored(cube, *grid(cube))
    return both.groupBy("x", "y").agg(F.round(F.sum(F.col("value") * F.col("opposite")), 6).alias("product"))


@query(f"""WITH {CUBE}, d AS (SELECT x, y, frame, value - avg(value) OVER (PARTITION BY x, y) AS d FROM cube), n AS (SELECT x, y, sum(d * d) AS s FROM d GROUP BY 1, 2),
    p AS (SELECT a.x, a.y, b.x AS x2, b.y AS y2, sum(a.d * b.d) AS p FROM d a JOIN d b ON a.frame = b.frame AND (a.x < b.x OR (a.x = b.x AND a.y <= b.y)) GROUP BY 1, 2, 3, 4)
    SELECT p.x, p.y, x2, y2, round(p / (sqrt(a.s * b.s) + 2.220446049250313e-16), 5) + 0.0 AS value FROM p JOIN n a ON a.x = p.x AND a.y = p.y JOIN n b ON b.x = x2 AND b.y = y2""")
def correlation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.correlation_map(src.series(spark, sf_dir))
    rounded = F.signum("value") * F.floor(F.abs("value") * 1e5 + 0.5) / 1e5  # half away from zero as F.round, without a decimal object for every pair
    return out.select("x", "y", "x2", "y2", (rounded + 0.0).alias("value"))


@query(f"WITH {OBSCON} SELECT a.key, b.key AS key2, round({CORR.format(a='a.value', b='b.value')}, 6) AS value FROM obscon a JOIN obscon b USING (frame) GROUP BY 1, 2")
def covariate_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.correlation_matrix(src.obscon(spark, sf_dir))
    return out.select("key", "key2", F.round("value", 6).alias("value"))


@query(f"WITH {OBSCON} SELECT frame, round(max(value) FILTER (key = 'click'), 6) AS click, round(max(value) FILTER (key = 'view'), 6) AS view FROM obscon WHERE key IN ('click', 'view') GROUP BY 1")
def covariates_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ts.selected(src.obscon(spark, sf_dir), ["click", "view"])
    return ts.wide(chosen, ["click", "view"]).select("frame", *[F.round(k, 6).alias(k) for k in ("click", "view")])


@query(f"WITH {CUBE} SELECT x, y, frame, round(value, 6) AS value, 1 AS n_parts FROM cube")
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split by position into four partial results and merge them again."""
    cube = src.dense_cube(spark, sf_dir)
    split = masks.split_of(src.series(spark, sf_dir).select("dataset", "x", "y"), 4, ["dataset"])
    rows = cube.join(split, ["dataset", "x", "y"])
    out = ts.merged([rows.filter(F.col("split") == k).drop("split") for k in range(4)], ["x", "y", "frame"])
    return out.select("x", "y", "frame", F.round("value", 6).alias("value"), F.col("n_parts").cast("int"))


@query("""WITH names AS (SELECT 'out/' || event_type || '_' || (event_id % 7) || '-8.parquet' AS path FROM events),
    parts AS (SELECT regexp_extract(path, '([^/]*)_(\\d+)-(\\d+)', 1) AS prefix, CAST(regexp_extract(path, '_(\\d+)-', 1) AS INT) AS split, CAST(regexp_extract(path, '-(\\d+)', 1) AS INT) AS n FROM names)
    SELECT prefix, count(DISTINCT split) AS found, max(n) AS wanted, count(DISTINCT split) = max(n) AS complete FROM parts GROUP BY 1""")
def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events")
    path = F.concat(F.lit("out/"), F.col("event_type"), F.lit("_"), F.col("event_id") % 7, F.lit("-8.parquet"))
    return src.split_completeness(src.split_names(e.select(path.alias("path"))))


@query(f"""WITH {ITEMS}, w AS (SELECT *, avg(value) FILTER (frame % 3 <> 0) OVER p AS m, stddev_pop(value) FILTER (frame % 3 <> 0) OVER p AS s FROM items WINDOW p AS (PARTITION BY x, y))
    SELECT x, y, frame, round((value - m) / (CASE WHEN s = 0 THEN 1 ELSE s END), 5) + 0.0 AS scaled FROM w""")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled by the rows outside fold 0 of three."""
    cube = src.item_cube(spark, sf_dir)
    out = ts.standardised(cube, ["x", "y"], train=ts.fold_of(F.col("frame"), 3) != 0)
    return out.select("x", "y", "frame", (F.round("scaled", 5) + 0.0).alias("scaled"))


@query(f"WITH {CUBE} SELECT frame, round(quantile_cont(abs(value), 0.999), 6) AS scale FROM cube GROUP BY 1")
def percentile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.dense_cube(spark, sf_dir).groupBy("frame").agg(F.round(F.percentile(F.abs("value"), F.lit(0.999)), 6).alias("scale"))


@query(f"""WITH {ITEMS} SELECT x, y, round(value, 6) AS peak, frame FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY value DESC, frame) AS k FROM items) WHERE k = 1""")
def first_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, frame = ts.first_peak()
    return src.item_cube(spark, sf_dir).groupBy("x", "y").agg(F.round(top, 6).alias("peak"), frame.cast("int").alias("frame"))


@query(f"WITH {CUBE} SELECT x, y, frame, round(value / nullif(max(abs(value)) OVER (PARTITION BY frame), 0), 6) + 0.0 AS value FROM cube")
def over_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir)
    return cube.select("x", "y", "frame", (F.round(ts.over_largest(F.col("value"), ["frame"], absolute=True), 6) + 0.0).alias("value"))


@query(f"""WITH {CUBE} SELECT CAST(f AS INT) AS fold, x, y, round(avg(value) FILTER (frame % 4 = f), 6) AS held_out, round(avg(value) FILTER (frame % 4 <> f), 6) AS train
    FROM cube, range(0, 4) r(f) GROUP BY 1, 2, 3""")
def fold_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows are all rows without the held-out fold: their sums are the totals minus its own."""
    cube = src.dense_cube(spark, sf_dir).withColumn("fold", ts.fold_of(F.col("frame"), 4))
    sums = cube.groupBy("x", "y", "fold").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    w = Window.partitionBy("x", "y")
    train = (F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))
    return sums.select("fold", "x", "y", F.round(F.col("s") / F.col("n"), 6).alias("held_out"), F.round(train, 6).alias("train"))


@query(f"WITH {CUBE} SELECT CAST(floor(i * (CAST(last AS DOUBLE) / 9) + 1e-9) AS INT) AS signal_time FROM dim, range(0, 10) r(i)")
def signal_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.signal_times(src.dense_cube(spark, sf_dir).select("dataset", "frame"), 10).select("signal_time")


READINGS = "r AS (SELECT event_type AS parameter, ts, epoch_us(ts) / 1e6 AS t, CAST(value AS DOUBLE) AS value FROM events)"


@query(f"""WITH {READINGS}, a AS (SELECT *, coalesce(lag(value) OVER w * (t - lag(t) OVER w), 0) AS area FROM r WINDOW w AS (PARTITION BY parameter ORDER BY ts))
    SELECT parameter, epoch_us(ts) AS us, round(sum(area) OVER (PARTITION BY parameter ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS integral FROM a""")
def running_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.running_integral(src.readings(spark, sf_dir))
    return out.select("parameter", F.unix_micros("ts").alias("us"), F.round("integral", 2).alias("integral"))


@query("""SELECT event_type AS parameter, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS timestamp, round(CAST(value AS DOUBLE), 4) AS value FROM events
    WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-01 05:58:00' AND TIMESTAMP '2024-01-02 12:02:00'""")
def readings_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = src.readings_between(src.readings(spark, sf_dir), "click", "2024-01-01 06:00:00", "2024-01-02 12:00:00")
    return out.select("parameter", "timestamp", F.round("value", 4).alias("value"))


@query(f"""WITH {ITEMS}, {OBSCON} SELECT key, round(regr_slope(i.value, o.value), 6) AS slope, round(regr_intercept(i.value, o.value), 4) AS intercept
    , round({CORR.format(a='i.value', b='o.value')}, 6) AS r FROM items i JOIN obscon o USING (frame) GROUP BY 1""")
def covariate_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.obscon(spark, sf_dir).select("dataset", "frame", "key", F.col("value").alias("o"))
    met = src.item_cube(spark, sf_dir).join(o, ["dataset", "frame"])
    return met.groupBy("key").agg(F.round(F.regr_slope("value", "o"), 6).alias("slope"), F.round(F.regr_intercept("value", "o"), 4).alias("intercept"), F.round(ts.pearson(F.col("value"), F.col("o")), 6).alias("r"))


@query(f"WITH {CUBE}, {FRAMES} SELECT count(*) AS unmatched, round(max(parang) - min(parang), 6) AS rotation FROM frames f FULL JOIN (SELECT DISTINCT frame FROM cube) c USING (frame)".replace("count(*) AS unmatched", "count(*) FILTER (c.frame IS NULL OR f.frame IS NULL) AS unmatched"))
def field_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = src.dense_cube(spark, sf_dir).select("dataset", "frame")
    frames = src.frames(cube)
    lost = joins.unmatched_frames(cube, frames).groupBy("dataset").count()
    out = ts.field_rotation(frames).join(lost, "dataset", "left")
    return out.select(F.coalesce("count", F.lit(0)).cast("long").alias("unmatched"), F.round("rotation", 6).alias("rotation"))


@query(f"""WITH {CUBE}, p AS (SELECT DISTINCT x, y, x - (sx / 2 - 0.5) AS dx, y - (sy / 2 - 0.5) AS dy FROM cube, dim)
    SELECT x, y, round(sqrt(dx * dx + dy * dy), 6) AS sep, round((atan2(dy, dx) - pi() / 2) % (2 * pi()), 6) + 0.0 AS angle,
      round(sqrt(dx * dx + dy * dy) * 0.0271, 6) AS arcsec, round(sqrt(dx * dx + dy * dy) * 0.0271 / 0.0956, 6) AS lod,
      round(sx / 2 - 0.5 + dx * cos(radians(30)) - dy * sin(radians(30)), 6) AS rx, round(sy / 2 - 0.5 + dx * sin(radians(30)) + dy * cos(radians(30)), 6) AS ry FROM p, dim""")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = src.series(spark, sf_dir).select("x", "y")
    sx, sy = grid(pixels)
    sep, angle = fx.cartesian_to_polar(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy))
    rx, ry = fx.rotated(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), F.lit(30.0))
    r = lambda c: F.round(c, 6)
    return pixels.select("x", "y", r(sep).alias("sep"), (r(angle) + 0.0).alias("angle"), r(sep * 0.0271).alias("arcsec"), r(sep * 0.0271 / 0.0956).alias("lod"), r(rx).alias("rx"), r(ry).alias("ry"))


@query(f"""WITH {ITEMS}, q AS (SELECT frame, x, y, value / 40 AS ratio FROM items)
    SELECT frame, x, y, round(-2.5 * log10(ratio), 6) AS mag, round(pow(10, -(-2.5 * log10(ratio)) / 2.5), 6) AS back,
      round(2 * pi() * ratio * 1.44 * (1 - exp(-0.25 / (2 * 1.44))), 6) AS disk, round(greatest(least(ratio, 0.25), 0.2), 6) AS clipped FROM q""")
def fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = src.item_cube(spark, sf_dir).withColumn("ratio", F.col("value") / 40)
    r = lambda c: F.round(c, 6)
    mag = fx.magnitudes(F.col("ratio"))
    return q.select("frame", "x", "y", r(mag).alias("mag"), r(fx.flux_ratio(mag)).alias("back"), r(fx.gaussian_integral(F.col("ratio"), F.lit(1.2))).alias("disk"), r(fx.clipped(F.col("ratio"), 0.2, 0.25)).alias("clipped"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, round(epoch_us(ts) / 1e6, 3) AS seconds,
      epoch_us(date_trunc('minute', ts)) // 1000000 - (minute(ts) % 5) * 60 AS down, epoch_us(date_trunc('minute', ts)) // 1000000 + (5 - minute(ts) % 5) * 60 AS up FROM events""")
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"), F.round(F.unix_micros("ts") / 1e6, 3).alias("seconds"), F.unix_timestamp(fx.round_minutes(F.col("ts"), False)).alias("down"), F.unix_timestamp(fx.round_minutes(F.col("ts"), True)).alias("up"))


@query(f"""WITH {READINGS}, g AS (SELECT DISTINCT parameter, floor(t / 3600) * 3600 AS hour FROM r)
    SELECT parameter, epoch_us(ts) AS us, CAST((SELECT min(hour) FROM g WHERE g.parameter = r.parameter AND abs(hour - t) = (SELECT min(abs(hour - t)) FROM g WHERE g.parameter = r.parameter)) AS DOUBLE) AS hour FROM r""")
def nearest_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading with the nearest full hour that has readings."""
    r = src.readings(spark, sf_dir).withColumn("t", F.unix_micros("ts") / 1e6)
    hours = r.select("parameter", (F.floor(F.col("t") / 3600) * 3600).cast("double").alias("hour")).distinct()
    return joins.nearest(r.select("parameter", "ts", "t"), hours, "t", "hour", ["parameter"]).select("parameter", F.unix_micros("ts").alias("us"), "hour")


@query(f"WITH {CUBE} SELECT x, y, round(sqrt(list_sum(list(value * value))), 5) AS norm, round(sum(value * (frame + 1)), 5) AS ramp FROM cube GROUP BY 1, 2")
def series_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.series(spark, sf_dir)
    ramp = F.transform("v", lambda e, i: (i + 1).cast("double"))
    return s.select("x", "y", F.round(F.sqrt(fx.dot(F.col("v"), F.col("v"))), 5).alias("norm"), F.round(fx.dot(F.col("v"), ramp), 5).alias("ramp"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, round(0.1 * pow(1000, (json_extract(props, '$.k')::INT % 16) / 15.0), 6) AS alpha FROM events""")
def nested_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting from each JSON configuration, and the alpha it selects of 16 in equal ratios."""
    e = src.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("config"))
    alphas = fx.geometric_steps(0.1, 100.0, 16)
    return e.select("event_id", F.col("config.k").alias("k"), F.round(F.element_at(alphas, F.col("config.k") % 16 + 1), 6).alias("alpha"))
