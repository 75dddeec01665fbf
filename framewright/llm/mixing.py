"""Mixing sources to target weights, in fixed-length blocks of words.

DataFrame functions only. The documents of a source, in hashed order, form one stream of words, cut
into blocks. A source's slots are its target over its mean words per block, the fraction drawn. Output shards have
SLOTS_PER_SHARD slots (the last one the rest), and every slot draws its source with probability in proportion to
slots, so a shard's counts are multinomial. Over all shards a source comes out a little above or below its slots, by
about the square root of them: what is above, at places chosen by a permutation, goes to the sources below. The k-th slot of
a source takes block p(k mod B), where p is a pseudorandom permutation of its B blocks that changes with
each pass over them. Slots and documents meet by block index.

No source has slots beyond two passes over it, so no document is taken more than twice.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; repeated rows are separate documents; without documents, or without words,
nothing is taken. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.store import small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: All sources share so many times the words there are; a source gives at most MOST times its own.
TOTAL, MOST = 1.5, 2
BLOCK_WORDS, SLOTS_PER_SHARD = 64, 1024
#: Rows whose running totals one task sums; the totals of such groups are summed in turn.
GROUP = 2000
_ROUNDS = range(10)
SLOTS_PER_TASK = 1 << 22


@dataclass(frozen=True)
class Mix:
    """``documents``: a row per input row with its place in its source's stream; ``sources``: sizes and
    targets; ``slots``: shard, slot, sid, block."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def _before(df: DataFrame, key: str, group: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Total of ``value`` over the earlier rows of the same key, through totals by group (which follows the order)."""
    df = df.withColumn("_g", group)
    sums = df.groupBy(key, "_g").agg(F.sum(value).alias("_s"))
    ahead = F.sum("_s").over(Window.partitionBy(key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(key, "_g", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.sum(value).over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums.hint("merge"), [key, "_g"]).withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_g", "_ahead", "_inside")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, sid, source_size, target: by weight, none above ``most`` times its size.

    Raising all targets together, in proportion to weight, the sources that reach their limit first
    are those of the smallest limit per weight. One row per source is sorted here, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))) + 1)
    rows = rows.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio, everything = Window.orderBy("ratio", "sid"), Window.partitionBy()
    rows = (
        rows.withColumn("full", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) * float(total) - F.col("full")) / F.col("open"))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit")))).select("source", "sid", "source_size", "target")


def _uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def _permuted(df: DataFrame, name: str, k: str, size: str, seed: int) -> DataFrame:
    """``df`` with the place of k mod ``size`` under a permutation keyed by ``sid``, another one for each pass.

    A Feistel network on x = left * b + right with a = floor(sqrt(size)) and b = size div a: each round adds a
    hash of one part to the other. The fewer than a numbers from a * b on stay where they are; a keyed rotation of all numbers
    after every four rounds brings them into the next four, so that no walk along a cycle is needed. One projection per round: written
    as one expression, a round would be repeated for each of its uses.
    """
    df = df.withColumn("_size", F.col(size).cast("long")).withColumn("_key", F.expr(f"xxhash64({seed}, sid, {k} div _size)")).withColumn("_x", F.expr(f"cast({k} % _size AS bigint)"))
    df = df.withColumn("_a", F.expr("cast(greatest(floor(sqrt(_size)), least(_size, 2)) AS bigint)")).withColumn("_b", F.expr("_size div _a"))
    for i in _ROUNDS:
        if i % 5 == 4:
            x = f"(_x + pmod(xxhash64(_key, {i}), _size)) % _size"
        elif i % 2 == 0:
            x = f"if(_x >= _a * _b, _x, (_x div _b + pmod(xxhash64(_key, {i}, _x % _b), _a)) % _a * _b + _x % _b)"
        else:
            x = f"if(_x >= _a * _b, _x, _x div _b * _b + (_x % _b + pmod(xxhash64(_key, {i}, _x div _b), _b)) % _b)"
        df = df.withColumn("_x", F.expr(x))
    return df.withColumn(name, F.col("_x")).drop("_size", "_key", "_x", "_a", "_b")


def _drawn(sources: DataFrame, n_slots: int, seed: int) -> DataFrame:
    """shard, sid, n: how many slots of each shard draw each source.

    Slot j draws a number below ``n_slots``; the source whose interval holds it is found by tiles, with at most two candidates on average.
    """
    spark = sources.sparkSession
    intervals = sources.filter("slots > 0").withColumn("end", F.sum("slots").over(Window.orderBy("sid"))).withColumn("begin", F.col("end") - F.col("slots"))
    width = max(1, n_slots // max(1, sources.count()))
    tiles = intervals.select("sid", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))).alias("tile"))
    tiles = small(written(tiles, "mix-tiles"))
    value = F.floor(_uniform(F.lit(seed), F.lit(-2), F.col("id")) * n_slots)
    slots = spark.range(n_slots).select(F.floor(F.col("id") / SLOTS_PER_SHARD).alias("shard"), value.alias("v")).withColumn("tile", F.floor(F.col("v") / width))
    return slots.join(tiles, "tile").filter("begin <= v AND v < end").groupBy("shard", "sid").agg(F.count("*").alias("n"))


def _slots(sources: DataFrame, seed: int) -> DataFrame:
    """shard, sid, k, blocks: every slot of every source once, in the shard that drew it or that got it in exchange."""
    n_slots = int(sources.agg(F.sum("slots")).first()[0] or 0)
    counts = written(_drawn(sources, n_slots, seed), "mix-counts")
    totals = sources.select("sid", "blocks", "slots").join(counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").na.fill(0, ["drawn"])
    above, below = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    ahead = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = written(totals.withColumn("above_before", ahead(above)).withColumn("below_before", ahead(below)), "mix-totals")

    placed = _before(counts, "sid", F.floor(F.col("shard") / GROUP), ["shard"], "n", "first")
    spark = sources.sparkSession
    placed = placed.repartition(max(spark.sparkContext.defaultParallelism, n_slots // SLOTS_PER_TASK), "sid", "shard")  # few rows here, many slots below
    rows = placed.join(small(totals), "sid").select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i"))
    rows = _permuted(rows, "mixed", "i", "drawn", seed + 1)
    rows = written(rows.select("shard", "sid", "blocks", "slots", "above_before", F.when(F.col("drawn") > F.col("slots"), F.col("mixed")).otherwise(F.col("i")).alias("k")), "mix-draws")
    kept = rows.filter("k < slots").select("shard", "sid", "k", "blocks")
    given = rows.filter("k >= slots").select("shard", (F.col("above_before") + F.col("k") - F.col("slots")).alias("r"))
    wanted = totals.filter("drawn < slots").select("sid", "blocks", "below_before", "drawn", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("k"))
    wanted = wanted.select("sid", "k", "blocks", (F.col("below_before") + F.col("k") - F.col("drawn")).alias("r"))
    return kept.unionByName(given.join(wanted.hint("merge"), "r").select("shard", "sid", "k", "blocks"))


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = 7) -> Mix:
    """Plan the mix of all documents; reruns agree."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    n_rows = sizes.count()
    sources = source_targets(sizes, weights, total, most)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    expected = F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), "source_size"), F.lit(0.0))
    # A limit of whole passes is kept against rounding; no draw goes beyond it.
    drawn_count = F.least(F.floor(expected + _uniform(F.lit(seed), F.lit(-1), F.col("sid")) * (1 - 1e-9) + 1e-9), F.col("blocks") * int(most)).cast("long")
    sources = written(sources.withColumn("slots", drawn_count), "mix-sources")

    groups = max(1, n_rows // GROUP)
    placed = sizes.join(small(sources.select("source", "sid").withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("h", _uniform(F.lit(seed), F.col("doc_id"), F.col("size")))
    documents = written(_before(placed, "sid", F.floor(F.col("h") * groups), ["h", "doc_id", "size"], "size", "start").drop("h"), "mix-documents")
    slots = written(_permuted(_slots(sources, seed), "block", "k", "blocks", seed).drop("blocks"), "mix-slots")
    return Mix(documents, sources, slots, block_words)


def pieces(plan: Mix) -> DataFrame:
    """Which words of which document each block holds: sid, block, start (of the document), first, words."""
    n = plan.block_words
    rows = plan.documents.filter("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * n)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n)
    return rows.select("sid", "block", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"))


def taken(plan: Mix) -> DataFrame:
    """Every document with its source's size and target and the number of its words that the mix takes."""
    times = plan.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    sums = pieces(plan).join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = plan.documents.join(sums.hint("merge"), ["sid", "start"], "left").join(small(plan.sources.select("sid", "source_size", "target")), "sid")
    return rows.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"), "source")


def mixed_texts(plan: Mix, docs: DataFrame) -> DataFrame:
    """The mix itself: shard, sid, k, and the block's words joined by spaces.

    ``docs`` must have unique doc_id here. Texts are cut once per document; only blocks that slots take move on.
    """
    placed = pieces(plan).join(plan.documents.filter("size > 0").select("sid", "start", "doc_id"), ["sid", "start"])
    cut = placed.join(docs.select("doc_id", "text"), "doc_id").withColumn("words", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.col("first").cast("int") + 1, F.col("words").cast("int")), " "))
    return plan.slots.join(cut.select("sid", "block", "start", "words"), ["sid", "block"]).groupBy("shard", "sid", "k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "words"))), lambda p: p["words"]), " ").alias("text")
    )
