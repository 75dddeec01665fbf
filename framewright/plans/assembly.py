"""Queries over stored cubes and assembled datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans.basic import CUBE
from framewright.plans.detection import _r
from framewright.plans.studies import META, TARGETS
from framewright.sources import datasets as ds
from framewright.sources import tables as src

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {CUBE} SELECT x, y, frame, round(value, 6) AS value FROM cube WHERE x BETWEEN 9 AND 14 AND y BETWEEN 4 AND 11")
def pruned_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop read from the cube stored by place: most row groups are skipped."""
    path = f"{src.shared_folder(spark)}/cube-{uuid.uuid4().hex}"
    ds.write_cube(src.dense_cube(spark, sf_dir), path, files=8)
    return ds.read_crop(spark, path, (9, 14), (4, 11)).select("x", "y", "frame", F.round("value", 6).alias("value"))


@query(f"""WITH {META}, {TARGETS}, rows AS (SELECT l_linenumber AS dataset, CAST(l_orderkey % 24 AS INT) AS frame, l_partkey % 11 AS x, l_suppkey % 11 AS y, avg(ln(l_extendedprice)) AS v FROM lineitem WHERE l_linenumber < 7 GROUP BY 1, 2, 3, 4),
    c AS (SELECT dataset, count(DISTINCT frame) AS n_frames, count(*) AS n_cells, avg(v) AS mean FROM rows GROUP BY 1),
    angle AS (SELECT frame // 8 AS b, 8 * (frame // 8) AS s, frame, 17.0 + 40.0 * (frame // 8) + (frame % 8) * 5.0 AS parang FROM (SELECT CAST(range AS INT) AS frame FROM range(0, 24))),
    t AS (SELECT dataset, count(*) AS n FROM targets GROUP BY 1)
    SELECT CAST(c.dataset AS INT) AS dataset, n_frames, n_cells, round(mean, 6) AS mean, CAST((SELECT sum(parang) FROM angle) AS DOUBLE) AS angles, coalesce(t.n, 0) AS n_targets
    FROM c JOIN meta USING (dataset) LEFT JOIN t USING (dataset) WHERE c.dataset IN (SELECT dataset FROM meta) AND n_frames = 24""")
def assembled_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six line numbers as datasets with three exposures each, assembled, verified and read back."""
    rows = src.table(spark, sf_dir, "lineitem").filter("l_linenumber < 7")
    cell = [(F.col(c) % n).cast("int").alias(a) for c, n, a in (("l_orderkey", 24, "frame"), ("l_partkey", 11, "x"), ("l_suppkey", 11, "y"))]
    cube = rows.groupBy(F.col("l_linenumber").cast("int").alias("dataset"), *cell).agg(F.avg(F.log("l_extendedprice")).alias("value"))
    names = cube.select("dataset").distinct()
    k = F.col("k")
    blocks = names.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("dataset", (8 * k).alias("start"), (8 * k + 8).alias("end"), (17.0 + 40.0 * k).alias("first"), (52.0 + 40.0 * k).alias("last"))
    obscon = src.table(spark, sf_dir, "events").select((F.col("user_id") % 7 + 1).cast("int").alias("dataset"), (F.col("event_id") % 24).cast("int").alias("frame"), F.col("event_type").alias("key"), F.col("value").cast("double").alias("value"))
    parts = {"cube": cube, "frames": ds.frames_of_blocks(blocks), "obscon": obscon, "psf": src.templates(spark, sf_dir), "metadata": src.metadata(spark, sf_dir), "targets": src.targets(spark, sf_dir)}
    path = f"{src.shared_folder(spark)}/datasets-{uuid.uuid4().hex}"
    ds.assemble(parts, path)
    c = ds.published(spark, path, "cube").groupBy("dataset").agg(F.countDistinct("frame").alias("n_frames"), F.count("*").alias("n_cells"), F.round(F.avg("value"), 6).alias("mean"))
    a = ds.published(spark, path, "frames").groupBy("dataset").agg(_r(F.sum("parang")).alias("angles"))
    t = ds.published(spark, path, "targets").groupBy("dataset").agg(F.count("*").alias("n_targets"))
    return c.join(a, "dataset").join(t, "dataset", "left").fillna(0, ["n_targets"])
