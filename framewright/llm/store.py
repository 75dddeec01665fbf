"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1 << 18
#: Bits of a map of hashes, and bits of one of its rows.
MAP_BITS, MAP_ROW = 1 << 26, 1 << 12


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of this process if all of Spark is in this process; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{stem}_{k}") not in taken)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers per row, marked for broadcast if it has at most ``limit`` rows; else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the documents whose labels say one thing; a document labelled both ways is left out."""
    both = labels.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("other"))
    return both.filter(F.col(label) == F.col("other")).drop("other")


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing will read again.

    Spark frees the shuffle files of jobs that are over when the driver collects its garbage, by itself every half hour; here it is asked to.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def nodes_of(pairs: DataFrame) -> DataFrame:
    """The distinct nodes of a written table of pairs (a, b), marked for broadcast if they are few."""
    few = small_nodes(pairs)
    return few if few is not None else _ends(pairs)


def small_nodes(pairs: DataFrame) -> DataFrame | None:
    """``nodes_of`` the pairs if they are few, else None."""
    return F.broadcast(_ends(pairs)) if 2 * pairs.count() <= BROADCAST_ROWS else None


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A map of fixed size (8 MB) in which ``in_map`` finds all hashes in the column ``node``, and few others."""
    bit = F.col("node").bitwiseAND(F.lit(MAP_BITS - 1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for cells in batch["cells"]:
                own = np.zeros(MAP_ROW // 32, np.int64)
                own[cells.values.field("cell").to_numpy() % len(own)] = cells.values.field("bits").to_numpy()
                maps.append(np.packbits(np.unpackbits(own.astype("<u4").view(np.uint8), bitorder="little")).tobytes())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(maps, pa.binary())], ["row", "map"])

    one = F.expr("shiftleft(1L, cast(node & 31 as int))")
    cells = hashes.groupBy(F.floor(bit / 32).cast("int").alias("cell")).agg(F.bit_or(one).alias("bits"))  # numbers only, so Spark adds them up by hash
    each = cells.groupBy(F.floor(F.col("cell") * 32 / MAP_ROW).cast("int").alias("row")).agg(F.collect_list(F.struct("cell", "bits")).alias("cells"))
    found = np.zeros(MAP_BITS // 8, np.uint8)
    for r in each.mapInArrow(packed, "row int, map binary").collect():  # at most MAP_BITS / MAP_ROW rows of fixed size
        found[r.row * MAP_ROW // 8 : (r.row + 1) * MAP_ROW // 8] = np.frombuffer(r.map, np.uint8)
    return found


def in_map(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit in a map of ``bit_map``."""
    at = hashes.view(np.int64) & (MAP_BITS - 1)
    return (found[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
