"""Cubes stored for cropping, and datasets assembled, verified and published as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.joins import in_blocks
from framewright.sources.tables import manifest

#: Tables of a dataset, with the columns their rows are sorted by.
TABLES = {"cube": ("place", "frame"), "frames": ("frame",), "obscon": ("key", "frame"), "psf": ("x", "y"), "metadata": (), "targets": ("name",)}


def place(x: Column, y: Column, bits: int = 16) -> Column:
    """A number in which the bits of x and y alternate, so that pixels close to each other are mostly close in it."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for c, shift in ((x, 2 * k), (y, 2 * k + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1)), shift))
    return out


def write_cube(cube: DataFrame, path: str, files: int, group_bytes: int = 1 << 24) -> None:
    """The cube in ``files`` files per range of places, sorted by place: a row group holds few pixels, so crops read few groups."""
    rows = cube.withColumn("place", place(F.col("x"), F.col("y"))).repartitionByRange(files, "dataset", "place").sortWithinPartitions("dataset", "place", "frame")
    rows.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 1000).parquet(path)


def read_crop(spark: SparkSession, path: str, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Pixels of a written cube with x and y in closed ranges; the filters reach the row groups and pages, which know their least and largest x and y."""
    return spark.read.parquet(path).filter(F.col("x").between(*x) & F.col("y").between(*y)).drop("place")


def frames_of_blocks(blocks: DataFrame, width: int = 256) -> DataFrame:
    """(dataset, frame, parang) from exposures (dataset, start, end, first, last): angles in equal steps from ``first`` to ``last`` of each exposure.

    Frames are numbered by their dataset's exposures [start, end), which are met by interval; frames of none have no angle.
    """
    last = blocks.groupBy("dataset").agg(F.max("end").alias("n"))
    frames = last.select("dataset", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("frame"))
    met = in_blocks(frames, blocks, "frame", "dataset", width)
    step = F.try_divide(F.col("last") - F.col("first"), F.col("end") - F.col("start") - 1)
    return met.select("dataset", "frame", (F.col("first") + (F.col("frame") - F.col("start")) * F.coalesce(step, F.lit(0.0))).alias("parang"))


def assemble(parts: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the tables of datasets (``TABLES``, each with a column dataset) below ``path``, and return their manifest.

    Everything is staged first and the manifest is taken from what was written. Only complete datasets are published, each replacing its own partition of
    every table; of incomplete ones, and of datasets that are not among ``parts``, whatever was published before stays. Running it again
    gives the same tables.
    """
    spark = parts["cube"].sparkSession
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    staged = {}
    for name in TABLES:
        rows = parts[name].withColumn("place", place(F.col("x"), F.col("y"))) if name == "cube" else parts[name]
        rows.write.parquet(f"{staging}/{name}")
        staged[name] = spark.read.schema(rows.schema).parquet(f"{staging}/{name}")
    report = manifest(*(staged[n] for n in ("cube", "frames", "obscon", "psf", "metadata", "targets")))
    report.write.parquet(f"{staging}/manifest")
    report = spark.read.parquet(f"{staging}/manifest")
    whole = report.filter("complete").select("dataset")
    for name, order in TABLES.items():
        good = staged[name].join(whole, "dataset", "left_semi").repartitionByRange("dataset", *order).sortWithinPartitions("dataset", *order)
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(f"{path}/{name}")
    return report


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all published datasets."""
    return spark.read.parquet(f"{path}/{name}").drop("place")
