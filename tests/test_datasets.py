"""Stored cubes that are cropped in the scan, and datasets that are published whole or not at all."""

import pytest
from pyspark.sql import functions as F

from framewright.sources import datasets as ds
from framewright.sources import tables as src


def _scans(plan):
    """Nodes of a plan that read files."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found = [plan] if plan.getClass().getSimpleName() == "FileSourceScanExec" else []
    children = plan.children()
    for k in range(children.size()):
        found += _scans(children.apply(k))
    return found


def test_place_is_one_to_one_and_local(spark):
    rows = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y")).withColumn("p", ds.place(F.col("x"), F.col("y"))).collect()
    assert sorted(r.p for r in rows) == list(range(64 * 64))
    assert {(r.x, r.y) for r in rows if r.p < 16} == {(x, y) for x in range(4) for y in range(4)}


def test_crop_reads_few_row_groups(spark, tmp_path):
    n = 64 * 64 * 40
    cube = spark.range(n).select(F.lit("d").alias("dataset"), (F.col("id") % 40).cast("int").alias("frame"), (F.floor(F.col("id") / 40) % 64).cast("int").alias("x"), F.floor(F.col("id") / 2560).cast("int").alias("y"), F.rand(3).alias("value"))
    ds.write_cube(cube, f"{tmp_path}/cube", files=16, group_bytes=1 << 16)
    crop = ds.read_crop(spark, f"{tmp_path}/cube", (16, 23), (40, 47))
    assert len(crop.collect()) == 8 * 8 * 40
    (scan,) = _scans(crop._jdf.queryExecution().executedPlan())
    filters = scan.dataFilters().toString()
    assert all(f"{c}#" in filters for c in "xy") and "PushedFilters" in scan.metadata().toString()
    assert scan.metrics().apply("numOutputRows").value() <= n / 16
    want = cube.filter("x between 16 and 23 and y between 40 and 47").agg(F.sum("frame"), F.count("*")).first()
    assert tuple(crop.agg(F.sum("frame"), F.count("*")).first()) == tuple(want)


def _parts(spark, names, value=1.0, template=True):
    frames = spark.createDataFrame([(d, 0, 4, 10.0, 13.0) for d in names] + [(d, 4, 6, 20.0, 21.0) for d in names], "dataset string, start int, end int, first double, last double")
    cells = [(d, f, x, y, value + f) for d in names for f in range(6) for x in range(3) for y in range(2)]
    return {
        "cube": spark.createDataFrame(cells, "dataset string, frame int, x int, y int, value double"),
        "frames": ds.frames_of_blocks(frames, 2),
        "obscon": spark.createDataFrame([(d, f, "k", 0.5) for d in names for f in range(6)], "dataset string, frame int, key string, value double"),
        "psf": spark.createDataFrame([(d, 0, 0, 1.0) for d in names if template or d != names[-1]], "dataset string, x int, y int, value double"),
        "metadata": spark.createDataFrame([(d, 0.1) for d in names], "dataset string, pixscale double"),
        "targets": spark.createDataFrame([(names[0], "b", 1.0)], "dataset string, name string, separation double"),
    }


def _all(spark, path):
    return {n: sorted(map(str, ds.published(spark, path, n).collect())) for n in ds.TABLES}


def test_two_runs_are_one_and_a_broken_part_leaves_the_old_whole(spark, tmp_path):
    path = f"{tmp_path}/datasets"
    report = {r.dataset: r for r in ds.assemble(_parts(spark, ["a", "b"]), path).collect()}
    assert report["a"].complete and report["b"].complete and (report["a"].n_frames, report["a"].n_targets, report["b"].n_targets) == (6, 1, 0)
    first = _all(spark, path)
    assert len(first["cube"]) == 72 and {r.parang for r in ds.published(spark, path, "frames").filter("dataset = 'b'").collect()} == {10.0, 11.0, 12.0, 13.0, 20.0, 21.0}
    ds.assemble(_parts(spark, ["a", "b"]), path)
    assert _all(spark, path) == first
    report = {r.dataset: r.complete for r in ds.assemble(_parts(spark, ["a", "b"], value=5.0, template=False), path).collect()}
    assert report == {"a": True, "b": False}
    later = _all(spark, path)
    assert [r for r in later["cube"] if "dataset='b'" in r] == [r for r in first["cube"] if "dataset='b'" in r]
    assert [r for r in later["cube"] if "dataset='a'" in r] != [r for r in first["cube"] if "dataset='a'" in r] and len(later["psf"]) == 2


def test_frames_of_no_exposure_have_no_angle(spark):
    blocks = spark.createDataFrame([("d", 2, 4, 1.0, 2.0), ("d", 6, 7, 9.0, 9.5)], "dataset string, start int, end int, first double, last double")
    got = ds.frames_of_blocks(blocks).collect()
    assert sorted((r.frame, r.parang) for r in got) == [(2, 1.0), (3, 2.0), (6, 9.0)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        src.shared_folder(Session())
