"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's sketch holds the KEPT smallest hashes of its shingles. The smallest ``listed`` of them stand in inverted
lists: a pair at the threshold shares none of them with probability (1 - similarity) ** listed, below 10^-11, whatever the
number of documents that share a value. Pairs from the lists are ruled out by set sizes and signatures (linked.py), then by the sketch of the union;
whole shingle sets decide. Documents with equal words are one node.

Defined results: A-Z are lower-cased; a null or empty text, or one without words, has an empty set and
links with nothing; a text of fewer words than a shingle has one shingle of all its words; very long texts are cut whole; repeated rows and
ties are linked and get the same component; rows with a null doc_id take part, but never name a component
that has another row; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framewright.llm import text as tx
from framewright.llm.linked import Rule, link, most_differing, shared_lists
from framewright.llm.store import discard, fresh_name, nodes_of, small, written

KEPT = 128
#: Signatures of _WORDS * 64 bits, each of the smallest shingle under a function of its own. At similarity t a bit differs
#: with probability (1 - t) / 2.
_WORDS = 2
_BITS = [f"s{k}" for k in range(_WORDS)]
_A = np.random.default_rng(17).integers(1, 1 << 63, _WORDS * 64, dtype=np.uint64) * tx.U64(2) + tx.U64(1)
_SEEN = 1 << 20  # nodes a task remembers, not to send their sketches twice


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document; how many come before each document; node hashes."""
    low = tx.lower(raw)
    starts, ends, before = tx.words(low, offsets)
    hashes = tx.span_hash(low, starts, ends)
    nodes = tx.run_hash(hashes, before)
    count = np.diff(before)
    doc = np.repeat(np.arange(len(count)), count)
    windows = tx.window_hash(hashes, width)
    at = np.flatnonzero(doc[: len(windows)] == doc[width - 1 :]) if len(windows) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    size = np.maximum(count - width + 1, np.minimum(count, 1))
    upto = np.concatenate([[0], np.cumsum(size)])
    value = np.empty(upto[-1], np.uint64)
    value[upto[short]] = nodes[short]
    whole = np.ones(len(value), bool)
    whole[upto[short]] = False
    value[whole] = windows[at]
    return *tx.distinct(value, upto), nodes


def listed(percent: int) -> int:
    """How many of the smallest hashes are listed."""
    return min(KEPT, max(1, ceil(log(1e-11) / log(max(1 - percent / 100, 1e-11)))))


def signature(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the sets value[at[i]:at[i + 1]], a column for each 64 of them; zero for empty sets."""
    out = np.zeros((len(at) - 1, _WORDS), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    spread = value ^ (value >> tx.U64(29))
    for k, factor in enumerate(_A):
        least = np.minimum.reduceat(spread * factor, at[some])
        out[some, k // 64] |= (tx.mix(least) & tx.U64(1)) << tx.U64(k % 64)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (null without words), sketch (null where this task sent the node's before) and signature bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                value, at, nodes = shingle_sets(raw, offsets, width)
                size = np.diff(at)
                node = nodes.view(np.int64)
                kept = []
                for i, n in enumerate(size):
                    known = int(node[i])
                    if n == 0 or known in seen:
                        kept.append(None)
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(known)
                    kept.append(value[at[i] : min(at[i] + KEPT, at[i + 1])].view(np.int64))
                new = np.array([x is not None for x in kept], bool)
                bits = np.zeros((len(size), _WORDS), np.uint64)
                bits[new] = signature(value[np.repeat(new, size)], np.concatenate([[0], np.cumsum(size[new])]))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(node, mask=size == 0), pa.array(kept, pa.list_(pa.int64())), *[pa.array(bits[:, k].view(np.int64)) for k in range(_WORDS)]],
                    ["doc_id", "n_shingles", "node", "sketch", *_BITS],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, sketch array<long>" + "".join(f", {c} long" for c in _BITS))


def likely(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule the threshold out, from (a, b, sa, sb)."""
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [(batch[c].flatten().to_numpy().view(np.uint64), np.asarray(batch[c].offsets) - batch[c].offsets[0].as_py()) for c in ("sa", "sb")]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for v, o in flat)
                k = min(len(x), len(y))
                union = np.sort(np.concatenate([x, y]))
                both = union[1:][union[1:] == union[:-1]]
                last = union[np.concatenate([[True], union[1:] != union[:-1]])][k - 1]
                keep[i] = np.count_nonzero(both <= last) / k >= t - 6 * (t * (1 - t) / k) ** 0.5
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (a, b, ta, tb) whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                (va, oa, _), (vb, ob, _) = (shingle_sets(*tx.buffers(part[c]), width) for c in ("ta", "tb"))
                both = tx.overlaps(va, oa, vb, ob)
                keep[at : at + 512] = (both > 0) & (100 * both >= percent * (np.diff(oa) + np.diff(ob) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node) of all documents, and (node, root) of all linked nodes.

    Two documents are linked if 100 * intersection >= percent * union of their sets of word shingles.
    """
    sk = written(sketches(docs, width), "sketches")
    sent = sk.filter("sketch is not null")
    lists = written(shared_lists(sent.select(F.explode(F.slice("sketch", 1, listed(percent))).alias("v"), "node")), "lists")
    members = lists.select("node").distinct()
    own = written(sent.join(members, "node", "left_semi").dropDuplicates(["node"]), "members")
    rows = written(sk.select("doc_id", "n_shingles", "node"), "nodes")
    discard(sk)
    features = own.select("node", F.col("n_shingles").alias("n"), *_BITS)
    # A pair at the threshold is ruled out with probability below 10^-9.
    rule = Rule(percent, _WORDS, 1, most_differing(_WORDS * 64, max(1 - percent / 100, 0.01) / 2, 1e-9))

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        side = lambda x: own.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
        close = written(likely(pairs.join(side("a"), "a").join(side("b"), "b"), percent), "likely")
        texts = texts.join(nodes_of(close), "node", "left_semi")
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
        links = written(confirmed(close.join(side("a"), "a").join(side("b"), "b"), width, percent), "links")
        discard(close)
        return links

    def sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
        return written(texts.join(nodes, "node", "left_semi").mapInArrow(whole, "node long, values array<long>"), "sets")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                value, at, _ = shingle_sets(raw, offsets, width)
                yield pa.RecordBatch.from_arrays([batch["node"].slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))], ["node", "values"])

    roots = link(lists, features, rule, lambda nodes: _texts(docs, own, nodes), verify, sets)
    discard(own)
    return rows, roots


def _texts(docs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes; one row of ``docs`` stands for each."""
    wanted = written(own.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("id")), "wanted")
    met = docs.select("doc_id", "text").join(small(wanted), F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows of one doc_id may have different texts
            keep = np.zeros(batch.num_rows, bool)
            node = batch["node"].to_numpy()
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                low = tx.lower(raw)
                starts, ends, before = tx.words(low, offsets)
                keep[lo:hi] = tx.run_hash(tx.span_hash(low, starts, ends), before).view(np.int64) == node[lo:hi]
            yield batch.filter(pa.array(keep))

    texts = written(met.mapInArrow(same, "node long, text string").dropDuplicates(["node"]), "texts")
    discard(wanted)
    return texts


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node of every row; component_id is the smallest doc_id reachable."""
    rows, roots = near_duplicates(docs, width, percent)
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    rows = rows.join(smallest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "node", "root")


def with_nodes(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the node hash of each text as a further column (null without words)."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, count = [], []
            for _, _, raw, offsets in tx.slices(batch["text"]):
                low = tx.lower(raw)
                starts, ends, before = tx.words(low, offsets)
                node.append(tx.run_hash(tx.span_hash(low, starts, ends), before).view(np.int64))
                count.append(np.diff(before))
            flat = (np.concatenate(node), np.concatenate(count)) if node else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat[0], mask=flat[1] == 0)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*schema.fields, StructField(name, LongType())]))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all columns; rows without words all stay."""
    names = docs.columns
    node, winner, ident = (fresh_name(docs, x) for x in ("node", "winner", "ident"))
    found = classes(docs, width, percent).filter("node is not null")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("node").alias("n"))).alias("w"))
    first = first.select(F.col("w.n").alias(winner), F.col("w.doc_id").alias(ident))
    marked = with_nodes(docs, node)
    same = (F.col(node) == F.col(winner)) & F.col("doc_id").eqNullSafe(F.col(ident))
    kept = marked.join(first, same, "left_semi").dropDuplicates([node, "doc_id"])
    return kept.unionByName(marked.filter(F.col(node).isNull())).select(*names)
