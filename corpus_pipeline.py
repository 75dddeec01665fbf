"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Null and empty
texts of the input pass through all filters (they are not toxic, hold no lines, duplicate nothing and match no
item) and weigh nothing in the mix; a document whose last word goes with the repeated lines is dropped there. Rows equal in doc_id and text count as copies of one another from
the near-duplicate stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontaminate, linededup, mixing, neardup, toxicity
from framewright.llm.store import discard, fresh_name, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or the same one, has already; n_chars follows.

    A document of which no word is left goes: all of it stands elsewhere.
    """
    names = fresh_name(docs, "lines"), fresh_name(docs, "cut")
    found = linededup.without_repeated_lines(docs, counts=True, counts_as=names)
    found = found.filter((F.col(names[1]) == 0) | F.col("text").rlike(mixing.WORD))
    return found.select(*docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return neardup.without_near_duplicates(docs, width=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document under the target weights of the sources."""
    return mixing.taken(mixing.mix(docs))


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", lines_once),
    ("near_dedup", no_near_copies),
    ("decontaminate", no_benchmark),
    ("mix", mixed),
]
#: The models and sketches of the stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = written(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = made
    return docs
