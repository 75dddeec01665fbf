"""Queries over hypotheses: match of whole paths, and the signal estimate chosen by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import coords as fx
from framewright.operators import hypotheses as hy
from framewright.operators import joins, masks
from framewright.plans.basic import CUBE, FRAMES, grid
from framewright.plans.detection import EXPECTED, HYPOTHESIS, RESIDUAL, SHARE, SIGMA, TURNED, _hypotheses, _r
from framewright.sources import tables as src

QUERIES, ORACLES = {}, {}
SELECTED = 0.05


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Residuals keyed by signal time: less the mean of the frames where the expected signal is below 0.2.
MASKED = """masked AS MATERIALIZED (SELECT x, y, signal_time, frame, value - avg(value) FILTER (coalesce(expected, 0) < 0.2) OVER (PARTITION BY x, y, signal_time) AS r FROM cube JOIN expected USING (x, y, frame))"""
MATCHED = f"""psf AS (SELECT i, j, exp(-((i - 4) * (i - 4) + (j - 4) * (j - 4)) / (2 * {SIGMA} * {SIGMA})) AS tv FROM range(0, 9) a(i), range(0, 9) b(j)), ab AS (SELECT * FROM range(0, 2) a(a), range(0, 2) b(b)),
    way AS (SELECT b.x AS hx, b.y AS hy, b.signal_time, frame, ex + sx / 2 - 0.5 AS px, ey + sy / 2 - 0.5 AS py FROM best b JOIN path USING (x, y, signal_time), dim WHERE s > 0.1),
    raw_cells AS (SELECT hx, hy, signal_time, frame, q.x, q.y, q.x - px + 4 AS u, q.y - py + 4 AS w FROM way JOIN (SELECT DISTINCT x, y FROM cube) q ON abs(q.x - px) < 5 AND abs(q.y - py) < 5),
    stack AS (SELECT hx, hy, signal_time, frame, x, y, sum(tv * (1 - abs(u - i)) * (1 - abs(w - j))) AS v FROM raw_cells, ab JOIN psf ON i = floor(u) + a AND j = floor(w) + b GROUP BY 1, 2, 3, 4, 5, 6),
    cells AS MATERIALIZED (SELECT *, v / max(v) OVER (PARTITION BY hx, hy, signal_time) AS e FROM stack WHERE v > 0),
    top AS (SELECT hx, hy, signal_time, x, y, max(e) AS e, max(round(e, 9)) AS er FROM cells GROUP BY 1, 2, 3, 4, 5),
    aff AS (SELECT t.hx, t.hy, t.signal_time, t.x, t.y, min(frame) AS peak FROM top t JOIN cells c ON c.hx = t.hx AND c.hy = t.hy AND c.signal_time = t.signal_time AND c.x = t.x AND c.y = t.y AND round(c.e, 9) = t.er WHERE t.e >= 0.5 GROUP BY 1, 2, 3, 4, 5),
    near AS (SELECT frame AS peak, (SELECT arg_min(sig.signal_time, abs(sig.signal_time - f.frame) * 1000 + sig.signal_time) FROM sig) AS trained FROM frames f),
    sims AS (SELECT a.hx, a.hy, a.signal_time, a.x, a.y, coalesce(sum(e * r) / nullif(sqrt(sum(e * e) * any_value(rr)), 0), 0) AS s FROM aff a JOIN near USING (peak) JOIN cells c ON c.hx = a.hx AND c.hy = a.hy AND c.signal_time = a.signal_time AND c.x = a.x AND c.y = a.y
      JOIN masked m ON m.x = a.x AND m.y = a.y AND m.signal_time = trained AND m.frame = c.frame JOIN (SELECT x, y, signal_time AS ts, sum(r * r) AS rr FROM masked GROUP BY 1, 2, 3 HAVING count(r) = count(*)) n ON n.x = a.x AND n.y = a.y AND n.ts = trained WHERE NOT (a.hx = a.x AND a.hy = a.y) GROUP BY 1, 2, 3, 4, 5),
    matches AS MATERIALIZED (SELECT hx, hy, signal_time, avg(s) AS mean, median(s) AS median, count(*) AS n FROM sims GROUP BY 1, 2, 3)"""


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Default residuals, those keyed by signal time, and matches of the best hypothesis of each pixel."""
    res, expected, best = _hypotheses(spark, sf_dir)
    cube = src.dense_cube(spark, sf_dir)
    sx, sy = grid(src.series(spark, sf_dir))
    calm = F.avg(F.when(F.coalesce("expected", F.lit(0.0)) < 0.2, F.col("value"))).over(hy.Window.partitionBy("x", "y", "signal_time"))
    keyed = cube.join(expected, ["x", "y", "frame"]).select("dataset", "signal_time", "frame", "x", "y", (F.col("value") - calm).alias("value"))
    wanted = best.filter("signal_time is not null").select(F.lit("dense").alias("dataset"), F.col("x").alias("hx"), F.col("y").alias("hy"), "signal_time")
    frames = src.frames(cube)
    template = F.transform(src.gaussian_template(9, SIGMA), lambda c: c["tv"])
    cells = hy.overlay_cells(wanted, frames, src.series(spark, sf_dir), template, 9, sx, sy)
    pixels = hy.affected(cells, expected.select(F.lit("dense").alias("dataset"), "signal_time").distinct(), frames)
    return res, keyed, hy.path_matches(cells, pixels, keyed)


@query(f"WITH {CUBE}, {FRAMES}, {EXPECTED}, {RESIDUAL}, {HYPOTHESIS}, {MASKED}, {MATCHED} SELECT hx AS x, hy AS y, signal_time, round(mean, 5) + 0.0 AS mean, round(median, 5) + 0.0 AS median, n FROM matches")
def path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the pixels that a hypothesis's path affects follow it, each at the trained time nearest to its own peak."""
    m = _matched(spark, sf_dir)[2]
    return m.select(F.col("hx").alias("x"), F.col("hy").alias("y"), "signal_time", _r("mean", 5).alias("mean"), _r("median", 5).alias("median"), "n")


@query(f"""WITH {CUBE}, {FRAMES}, {EXPECTED}, {RESIDUAL}, {HYPOTHESIS}, {MASKED}, {MATCHED}, {TURNED},
    picked AS MATERIALIZED (SELECT d.x, d.y, d.frame, CASE WHEN m.hx IS NULL THEN d.value ELSE k.r END AS value FROM (SELECT res.* FROM res JOIN t USING (x, y)) d LEFT JOIN (SELECT * FROM matches WHERE mean >= {SELECTED}) m ON m.hx = d.x AND m.hy = d.y LEFT JOIN masked k ON k.x = d.x AND k.y = d.y AND k.frame = d.frame AND k.signal_time = m.signal_time),
    roi AS (SELECT turned.* FROM turned JOIN t USING (x, y)),
    back AS (SELECT q.frame, q.x, q.y, sum(coalesce(p.value, 0) * {SHARE.format(a='floor(px) + a', b='px')} * {SHARE.format(a='floor(py) + b', b='py')}) AS v FROM roi q CROSS JOIN ab LEFT JOIN picked p ON p.frame = q.frame AND p.x = floor(px) + a AND p.y = floor(py) + b GROUP BY 1, 2, 3)
    SELECT x, y, round(avg(v), 5) + 0.0 AS mean, round(median(v), 5) + 0.0 AS median FROM back GROUP BY 1, 2""")
def hypothesis_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal estimate after the fits: residuals chosen by path match, turned back, mean and median over frames."""
    res, keyed, matches = _matched(spark, sf_dir)
    sx, sy = grid(src.series(spark, sf_dir))
    inside = masks.circle(F.col("x"), F.col("y"), fx.center(sx), fx.center(sy), 6.0)
    picked = hy.signal_residuals(res.filter(inside), keyed, matches, SELECTED).withColumn("dataset", F.lit("dense"))
    cube = src.dense_cube(spark, sf_dir)
    turned = joins.derotated(picked, src.frames(cube), sx, sy)
    return turned.groupBy("x", "y").agg(_r(F.avg("value"), 5).alias("mean"), _r(F.median("value"), 5).alias("median"))
