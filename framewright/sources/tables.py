"""Scans, canonical tables, result sinks and sources.

Canonical tables are long: cube(dataset, frame, x, y, value), frames(dataset, frame, parang),
obscon(dataset, frame, key, value), readings(parameter, ts, integration_time, value). A missing value is NULL.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NX, NY = 25, 20  # grid of the dense cube at 500 vectors; more vectors add rows in y


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missing_as_null(value: Column) -> Column:
    """NaN, the missing value of numpy, as NULL."""
    return F.when(~F.isnan(value), value)


def dense_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pixels of a 25-wide grid, their components as frames."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select("vec_id", "label", F.posexplode("embedding").alias("frame", "v"))
    return cells.select(
        F.lit("dense").alias("dataset"),
        F.col("frame").cast("int"),
        (F.col("vec_id") % NX).cast("int").alias("x"),
        F.floor(F.col("vec_id") / NX).cast("int").alias("y"),
        missing_as_null(F.col("v").cast("double")).alias("value"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense cube as one time series per pixel: dataset, x, y, v."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("dense").alias("dataset"), (F.col("vec_id") % NX).cast("int").alias("x"), F.floor(F.col("vec_id") / NX).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("v"))


def item_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a sparse cube of 24 frames of 11 x 11 cells: mean logarithm of the extended price."""
    rows = table(spark, sf_dir, "lineitem")
    cell = [(F.col(c) % n).cast("int").alias(a) for c, n, a in (("l_orderkey", 24, "frame"), ("l_partkey", 11, "x"), ("l_suppkey", 11, "y"))]
    return rows.groupBy(*cell).agg(F.avg(F.log("l_extendedprice")).alias("value")).withColumn("dataset", F.lit("items"))


def frames(cube: DataFrame, first: float = 17.0, field: float = 120.0) -> DataFrame:
    """Angles that turn by ``field`` degrees over the frames of each dataset of ``cube``."""
    last = cube.groupBy("dataset").agg(F.max("frame").alias("last"))
    each = last.select("dataset", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame"))
    return each.select("dataset", "frame", (F.lit(first) + F.col("frame") * (F.lit(field) / F.col("last"))).alias("parang"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated readings of a parameter; each covers the minute before its time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("parameter"), F.col("ts").cast("timestamp").alias("ts"), F.lit(60.0).alias("integration_time"), F.col("value").cast("double").alias("value"))


def obscon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of the readings as covariates of 24 frames."""
    r = readings(spark, sf_dir)
    return r.groupBy(F.hour("ts").alias("frame"), F.col("parameter").alias("key")).agg(F.avg("value").alias("value")).withColumn("dataset", F.lit("items"))


def covariates(spark: SparkSession, sf_dir: str, n_frames: int = 64) -> DataFrame:
    """Events as covariates of the frames of the dense cube: the mean value of each kind of event that falls to a frame."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("event_id") % n_frames).cast("int").alias("frame"), F.col("event_type").alias("key")).agg(F.avg(F.col("value").cast("double")).alias("value")).withColumn("dataset", F.lit("dense"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integration times, filter and pixel scale of each dataset: one row per nation."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_nationkey").cast("int").alias("dataset"), (0.2 + 0.01 * k).alias("dit_stack"), F.lit(0.05).alias("dit_psf_template"), F.lit(0.0956).alias("lambda_over_d"),
        (0.02 + 0.001 * (k % 3)).alias("nd_filter"), F.lit(0.0271).alias("pixscale"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sources of each dataset: one row per supplier of the nation."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.col("s_nationkey").cast("int").alias("dataset"), F.col("s_name").alias("name"), (0.0271 * (3 + k % 5)).alias("separation"), (k * 37 % 360).cast("double").alias("position_angle"), (5.0 + k % 4).alias("contrast"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as one 11 x 11 template per dataset (the line number)."""
    rows = table(spark, sf_dir, "lineitem")
    cell = [(F.col(c) % 11).cast("int").alias(a) for c, a in (("l_partkey", "x"), ("l_suppkey", "y"))]
    return rows.groupBy(F.col("l_linenumber").cast("int").alias("dataset"), *cell).agg((F.avg("l_extendedprice") / 1e4).alias("value"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a table of evaluation results."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        (F.lit(2.0) + F.col("l_linenumber") % 7).alias("separation"),
        (F.lit(5.0) + F.floor(F.col("l_quantity") / 4) * 0.5).alias("expected_contrast"),
        F.substring(F.lit("abcdef"), (F.col("l_suppkey") % 6 + 1).cast("int"), F.lit(1)).alias("azimuthal_position"),
        (F.col("l_discount") * 10).alias("throughput"),
        F.pow(F.lit(10.0), -(12 - F.floor(F.col("l_quantity") / 4) * 0.8 + F.col("l_tax") * 10)).alias("fpf_median"),
    )


def gaussian_template(size: int = 9, sigma: float = 1.2) -> Column:
    """A square template as an inline array of (x, y, value); a few dozen cells."""
    c = size // 2
    cells = [(i, j, float(2.718281828459045 ** (-((i - c) ** 2 + (j - c) ** 2) / (2 * sigma**2)))) for i in range(size) for j in range(size)]
    return F.array(*[F.struct(F.lit(i).alias("tx"), F.lit(j).alias("ty"), F.lit(v).alias("tv")) for i, j, v in cells])


def readings_between(readings: DataFrame, parameter: str, start: str, end: str, pad_seconds: int = 120) -> DataFrame:
    """Readings of one parameter in a padded time range, with unix seconds, in order of time."""
    pad = F.expr(f"interval {int(pad_seconds)} seconds")
    low, high = F.to_timestamp(F.lit(start)) - pad, F.to_timestamp(F.lit(end)) + pad
    rows = readings.filter((F.col("parameter") == parameter) & F.col("ts").between(low, high))
    return rows.withColumn("timestamp", F.unix_timestamp("ts")).orderBy("ts")


def write_results(df: DataFrame, path: str, overwrite: bool = True, partition_by: tuple[str, ...] = ()) -> None:
    """Write a result table as Parquet; fail if it exists unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def split_names(paths: DataFrame, column: str = "path") -> DataFrame:
    """prefix, split, n_splits of file names ``<prefix>_<split>-<n_splits>``."""
    part = lambda k: F.regexp_extract(column, r"([^/]*)_(\d+)-(\d+)(?:\.\w+)?/?$", k)
    return paths.select(column, part(1).alias("prefix"), part(2).cast("int").alias("split"), part(3).cast("int").alias("n_splits")).filter("prefix <> ''")


def split_completeness(parts: DataFrame) -> DataFrame:
    """Per prefix: how many splits are there, how many there should be, and whether that is all."""
    found = parts.groupBy("prefix").agg(F.countDistinct("split").alias("found"), F.max("n_splits").alias("wanted"))
    return found.withColumn("complete", F.col("found") == F.col("wanted"))


def one_template(psf: DataFrame) -> DataFrame:
    """Assert that each dataset has one 2-D template: no (x, y) twice."""
    twice = psf.groupBy("dataset", "x", "y").count().groupBy("dataset").agg(F.max("count").alias("n"))
    ok = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.lit("template is not 2-D")).cast("boolean"))
    return psf.join(twice.select("dataset", ok.alias("ok")).filter("ok"), "dataset").drop("ok")


def manifest(cube: DataFrame, frames: DataFrame, obscon: DataFrame, psf: DataFrame, metadata: DataFrame, targets: DataFrame) -> DataFrame:
    """What an assembled dataset holds, one row each: frames, grid, field of angles, covariates, template, targets, and whether all is there.

    All tables are keyed by dataset; each is summed up before the join. Complete: an angle for every frame, a template, one row of metadata.
    """
    c = cube.groupBy("dataset").agg(F.countDistinct("frame").alias("n_frames"), (F.max("x") + 1).alias("size_x"), (F.max("y") + 1).alias("size_y"))
    a = frames.groupBy("dataset").agg(F.count("parang").alias("n_angles"), (F.max("parang") - F.min("parang")).alias("field"))
    o = obscon.groupBy("dataset").agg(F.countDistinct("key").alias("n_covariates"))
    p = psf.groupBy("dataset").agg(F.count("value").alias("n_template"))
    m = metadata.groupBy("dataset").agg(F.count("*").alias("n_metadata"))
    t = targets.groupBy("dataset").agg(F.count("*").alias("n_targets"))
    out = c
    for part in (a, o, p, m, t):
        out = out.join(part, "dataset", "left")
    out = out.fillna(0, ["n_angles", "n_covariates", "n_template", "n_metadata", "n_targets"])
    return out.withColumn("complete", (F.col("n_angles") == F.col("n_frames")) & (F.col("n_template") > 0) & (F.col("n_metadata") == 1))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of this process if all of Spark is in this process; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
