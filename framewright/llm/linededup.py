"""Line dedup: fuzzy lines by MinHash over character shingles.

Lines with a word, A-Z lower-cased, are sets of 5-character shingles (a shorter line is one shingle).
Signatures of 40 values are cut into 10 bands of 4; lines that share a band are candidates (at
similarity 0.8, 995 of 1000 pairs share one, at 0.85 all but one in 1,600), whole sets decide, and
union-find joins the links. Of each component the first line stays: that of the smallest doc_id
(null last), then of the smallest line number.

Short lines get one hash function per value; long lines get one hash for all values, dealt to
bins. Lines between the two lengths get both, so that no pair falls between. Lengths count distinct
shingles, so a line and its repetition are of one length.

Defined results: lines without a word are never removed; a null text stays null, an empty text
empty; very long texts and lines are compared whole; rows with equal doc_id and text are one document and keep the same lines; a document may
keep no line, and stays with an empty text; an empty table gives no rows. Columns other than doc_id and text are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.linked import Rule, link, most_differing, packed, packed_lists, record
from framewright.llm.store import bit_map, discard, fresh_name, in_map, small_nodes, written

WIDTH, PERCENT = 5, 80
BANDS, ROWS = 10, 4
_K = BANDS * ROWS
#: Lines of at least LONG distinct shingles are dealt to bins; up to LONG * 100 / PERCENT they get both signatures.
LONG = 192
#: Three bits of each value make a signature of two words. Pairs at the threshold that share a band are ruled out by it with probability below 10^-6.
RULE = Rule(PERCENT, 2, 3, most_differing(_K, 0.875 * (1 - PERCENT / 100), 1e-6))
_OWNERS = 16  # bits for the number of a line in ``tx.distinct``
_SEEN = 1 << 20
_MIXED = tx.mix(np.arange(1, (1 << 12) + 1, dtype=np.uint64))  # of the code points of most texts
_NEAR = 1 << 15  # values that are hashed at once
_PAIRS = 128  # pairs of lines that are compared at once
_POSTINGS = 1 << 19  # postings that a task packs at once
#: Lines of lists that stay open get a signature of so many values by functions of 32 bits of a shingle.
_SHARP = 128
SHARP_RULE = Rule(PERCENT, _SHARP // 32, 2, most_differing(_SHARP, 0.75 * (1 - PERCENT / 100), 1e-6))
_A = np.random.default_rng(11).integers(1, 1 << 63, _SHARP, dtype=np.uint64) * tx.U64(2) + tx.U64(1)


def shingles(raw: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lines (byte spans of lower-cased ``raw``, ascending), repeats included, and how many come before each line."""
    points, at = tx.code_points(raw, np.concatenate([left, right]))
    lo, hi = at[: len(left)], at[len(left) :]
    size = np.maximum(hi - lo - WIDTH + 1, np.minimum(hi - lo, 1))
    before = np.concatenate([[0], np.cumsum(size)])
    mixed = _MIXED.take(points) if len(points) and points.max() < len(_MIXED) else tx.mix(points.astype(np.uint64) + tx.U64(1))
    windows = tx.window_hash(mixed, WIDTH)
    place = np.repeat(lo - before[:-1], size)
    place += np.arange(before[-1])
    short = hi - lo < WIDTH
    if not short.any():
        values = windows.take(place)
    else:
        values = np.zeros(before[-1], np.uint64)
        whole = np.repeat(~short, size)
        values[whole] = windows[place[whole]]
        edges = np.stack([lo[short], hi[short]], 1).ravel()
        values[~whole] = np.concatenate([tx.run_hash(mixed[a:b], np.array([0, b - a])) for a, b in edges.reshape(-1, 2) if b > a] or [np.zeros(0, np.uint64)])
    return values, before


def _by_functions(values: np.ndarray, before: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least product of each run of values with each factor."""
    out = np.empty((len(before) - 1, len(factors)), values.dtype)
    cuts = np.searchsorted(before[:-1], np.arange(0, before[-1], _NEAR))
    for lo, hi in zip(cuts, [*cuts[1:], len(out)]):  # whole lines that stay in the processor's cache together
        if lo == hi:
            continue
        own, at = values[before[lo] : before[hi]], before[lo:hi] - before[lo]
        hashed = np.empty_like(own)
        for k, factor in enumerate(factors):
            np.minimum.reduceat(np.multiply(own, factor, out=hashed), at, out=out[lo:hi, k])
    return out


def _packed(signature: np.ndarray, rule: Rule) -> np.ndarray:
    """The last bits of each value, in the columns of the rule's words."""
    each = signature.shape[1] // rule.words
    return ((signature & tx.U64((1 << rule.bits) - 1)).reshape(len(signature), rule.words, each) << (np.arange(each, dtype=np.uint64) * tx.U64(rule.bits))).sum(2)


def _by_bins(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of ascending values the first in each of _K equal parts of their range."""
    n = len(before) - 1
    part, new = np.empty(len(values), np.uint8), np.ones(len(values), bool)
    for lo in range(0, len(values), _NEAR):
        here = values[lo : lo + _NEAR] >> tx.U64(64 - _OWNERS - 32)
        here *= tx.U64(_K)
        part[lo : lo + _NEAR] = here >> tx.U64(32)
    np.not_equal(part[1:], part[:-1], out=new[1:])
    new[before[:-1]] = True
    first = np.flatnonzero(new)
    place = np.repeat(np.arange(n) * _K, np.add.reduceat(new, before[:-1], dtype=np.int64)) + part[first]
    empty = np.ones(n * _K, bool)
    empty[place] = False
    out = np.zeros(n * _K, np.uint64)
    out[place] = values[first]
    out, empty = out.reshape(n, _K), empty.reshape(n, _K)
    while empty.any():  # an empty bin takes the value of the next filled one, marked by the distance
        rows = np.flatnonzero(empty.any(1))
        part, gap = out[rows], empty[rows]
        moved = np.where(gap & ~np.roll(gap, -1, 1), tx.mix(np.roll(part, -1, 1) + tx.U64(1)), part)
        out[rows] = moved
        empty[rows] = gap & np.roll(gap, -1, 1)
    return out


def signs(values: np.ndarray, before: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both kinds of signature, from the distinct shingles of lines: the lines that have it, their band hashes (even ones for the first kind) and signature words."""
    size = np.diff(before)
    found = []
    for kind, chosen, make in ((0, size * PERCENT <= LONG * 100, lambda v, b: _by_functions(v, b, _A[:_K])), (1, size >= LONG, _by_bins)):
        rows = np.flatnonzero(chosen & (size > 0))
        if not len(rows):
            found.append((rows, np.zeros((0, BANDS), np.uint64), np.zeros((0, 2), np.uint64)))
            continue
        use = np.repeat(chosen, size)
        signature = tx.mix(make(values[use], np.concatenate([[0], np.cumsum(size[rows])])))
        total = np.zeros((len(rows), BANDS), np.uint64)
        for r in range(ROWS):
            total = tx.mix(total * tx.U64(31) + signature[:, r::ROWS])
        total = tx.mix(total + np.arange(BANDS, dtype=np.uint64))
        found.append((rows, (total & ~tx.U64(1)) | tx.U64(kind), _packed(signature, RULE)))
    return found


def _inked(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes; first and end byte, document, number and node of each line with a word."""
    low = tx.lower(raw)
    left, right, doc, number = tx.lines(low, offsets)
    has = right > left
    if has.any():
        spans = np.stack([left[has], right[has]], 1).ravel()
        has[has] = np.logical_or.reduceat(np.append(tx.inked(low), False), spans)[::2]
    left, right, doc, number = left[has], right[has], doc[has], number[has]
    return low, left, right, doc, number, tx.span_hash(low, left, right)


def _signed(docs: DataFrame) -> DataFrame:
    """Packed postings of every line with a word by its bands, with its features, where this task has not sent them before."""
    kind = record(RULE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            for _, _, raw, offsets in tx.slices(batch["text"], 1 << 19):
                low, left, right, _, _, node = _inked(raw, offsets)
                new = _unseen(node, seen)
                values, before = tx.distinct(*shingles(low, left[new], right[new]), _OWNERS)
                size = np.diff(before)
                for rows, bands, words in signs(values, before):
                    own = np.empty((len(rows), BANDS), kind)
                    own["v"] = bands.view(np.int64)
                    for c, x in (("node", node[new[rows]].view(np.int64)), ("n", size[rows]), *((f"s{k}", words[:, k].view(np.int64)) for k in range(RULE.words))):
                        own[c] = x[:, None]
                    held.append(own.ravel())
                    count += own.size
                if count > _POSTINGS:
                    yield packed(np.concatenate(held))
                    held, count = [], 0
        if count:
            yield packed(np.concatenate(held))

    return docs.select("text").mapInArrow(run, "part int, data binary")


def _unseen(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """The first line of each node that is not in ``seen``, where it is put."""
    keys, first = np.unique(node, return_index=True)
    new = np.sort(first[np.array([k not in seen for k in keys.tolist()], bool)]) if len(keys) else first
    if len(seen) > _SEEN:
        seen.clear()
    seen.update(node[new].tolist())
    return new


def _places(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Every line with a word: its node and place, and its bytes where the map ``wanted`` has the node and this task has not sent them before."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"], 1 << 19):
                low, left, right, doc, number, node = _inked(raw, offsets)
                chosen = np.flatnonzero(in_map(shared.value, node))
                chosen = chosen[_unseen(node[chosen], seen)]
                data = low.tobytes()
                text = np.full(len(node), None, object)
                text[chosen] = [data[a:b] for a, b in zip(left[chosen].tolist(), right[chosen].tolist())]
                take = lambda c: batch[c].slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), take("doc_id").cast(pa.int64()), take("key"), pa.array(number, pa.int64()), pa.array(text, pa.binary())],
                    ["node", "doc_id", "key", "number", "line"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "node long, doc_id long, key long, number long, line binary")


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tx.buffers(column.cast(pa.string()))
    return tx.distinct(*shingles(raw, offsets[:-1], offsets[1:]), _OWNERS)


def _similar(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (a, b, ta, tb) whose whole shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, _PAIRS):
                part = batch.slice(at, _PAIRS)
                (va, oa), (vb, ob) = _sets(part["ta"]), _sets(part["tb"])
                both = tx.overlaps(va, oa, vb, ob, _OWNERS)
                keep[at : at + _PAIRS] = 100 * both >= PERCENT * (np.diff(oa) + np.diff(ob) - both)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def line_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written rows of ``_places``, and (node, root) of the lines that are similar to another line."""
    lists = written(packed_lists(_signed(docs), RULE, propose=True), "line-lists")
    places = []

    def texts(nodes: DataFrame) -> DataFrame:
        places.append(written(_places(docs, bit_map(nodes)), "lines"))
        return written(places[0].select("node", "line").filter("line is not null").repartition("node").dropDuplicates(["node"]), "line-texts")

    def sharp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values, before = _sets(part["line"])
                packed = _packed(tx.mix(_by_functions((values >> tx.U64(16)).astype(np.uint32), before, _A.astype(np.uint32)).astype(np.uint64)), SHARP_RULE)
                columns = [np.ascontiguousarray(packed[:, k]).view(np.int64) for k in range(SHARP_RULE.words)]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(np.diff(before)), *map(pa.array, columns)], ["node", *SHARP_RULE.names])

    def sharper(nodes: DataFrame, texts: DataFrame) -> DataFrame:
        met = texts.join(nodes, "node", "left_semi")
        return written(met.mapInArrow(sharp, "node long" + "".join(f", {c} long" for c in SHARP_RULE.names)), "line-signs")

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        few = small_nodes(pairs)
        texts = texts.join(few, "node", "left_semi") if few is not None else texts
        side = lambda x: texts.select(F.col("node").alias(x), F.col("line").alias(f"t{x}"))
        return written(_similar(pairs.join(side("a"), "a").join(side("b"), "b")), "links")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values, before = _sets(part["line"])
                yield pa.RecordBatch.from_arrays([part["node"], pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(values.view(np.int64)))], ["node", "values"])

    def sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
        return written(texts.join(nodes, "node", "left_semi").mapInArrow(whole, "node long, values array<long>"), "line-sets")

    roots = link(lists, None, RULE, texts, verify, sets, (SHARP_RULE, sharper))
    return places[0], roots


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, numbers): the line numbers to remove from the documents of that doc_id and xxhash64 of the text."""
    lines, roots = line_roots(docs)
    often = lines.groupBy("node").count().filter("count > 1").select("node")
    groups = often.join(roots, "node", "full").select("node", F.coalesce("root", "node").alias("root"))
    seen = lines.select("node", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "number").alias("at"))
    seen = written(seen.join(groups, "node").select("root", "at"), "line-places")
    first = seen.groupBy("root").agg(F.min("at").alias("first")).select("root", "first")
    again = seen.join(first, "root").filter("at <> first")
    cuts = written(again.groupBy("at.doc_id", "at.key").agg(F.collect_set("at.number").alias("numbers")), "line-cuts")
    discard(lines, roots, seen)
    return cuts


def without_repeated_lines(docs: DataFrame, counts: bool = False, counts_as: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``; with ``counts``, also the numbers of lines and of those cut."""
    key, ident, cuts, parts = (fresh_name(docs, x) for x in ("key", "ident", "cuts", "parts"))
    gone = repeated_lines(docs).select(F.col("doc_id").alias(ident), F.col("key").alias(key), F.col("numbers").alias(cuts)).hint("shuffle_hash")  # texts are not sorted
    met = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(key)), "left")
    met = met.withColumn(parts, F.split("text", "\n"))
    n = F.size(parts).cast("long")
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), n - 1), cuts)  # by a set: linear in the lines of a text
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i.cast("int"))), "\n")
    lines = [n.alias(counts_as[0]), F.coalesce(F.size(cuts), F.lit(0)).cast("long").alias(counts_as[1])] if counts else []
    return met.select(*[F.when(F.col(cuts).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns], *lines)
