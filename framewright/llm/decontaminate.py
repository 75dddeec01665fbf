"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, A-Z lower-cased. Masks compare 4 words within SPAN; hashes of benchmark
items and of texts under the same mask are joined, so a substituted word at a left-out position does
not matter. Each hit fixes how item and text line up; the best stretch of that alignment (+1 for an
equal word, -1 for another) must score ``min(LEAST, words of the item)``.

No such stretch is missed: cut into runs of SPAN words from its start, one run has at least 4 equal
words (with at most 3 in each, the score is at most the words left over, fewer than SPAN), and the
masks are all ways to choose them. Items shorter than LEAST are found as whole runs.

The benchmark is used in blocks of about BLOCK_SEEDS seeds; each block is broadcast and meets
all texts. With more than one block, what a block finds (or leaves) is written to the shared folder and its
broadcast destroyed before the next one is built: a larger benchmark takes more passes, not more memory. Items are
dealt to blocks by hash, so only an item that is itself longer than a block makes one larger.

Defined results: null and empty texts or items have no words and match nothing; texts of any length are read whole, in
slices of whole texts; repeated items are all reported; repeated rows are all judged; an empty benchmark or table gives no rows;
of stretches that score the same in a document and item, that of the smallest alignment is reported. Columns other
than doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.store import discard, written

SPAN = 6
#: The positions that each mask compares.
MASKS = tuple((0, *rest) for rest in combinations(range(1, SPAN), 3))
LEAST = 8
BLOCK_SEEDS = 1 << 21
_HITS = 1 << 20  # hits looked at together
SCHEMA = "doc_id long, item_id long, start_word long, end_word long, matched_words long, contaminated boolean"


@dataclass
class Block:
    """Words of some items end to end, and their seeds sorted by hash."""

    item_ids: list
    words: np.ndarray
    begins: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    marks: np.ndarray  # flags by low bits of the seeds: a quick first test
    short_widths: list[int]


def _seed(hashes: np.ndarray, k: int) -> np.ndarray:
    return tx.window_hash(hashes, MASKS[k][-1] + 1, MASKS[k]) + tx.U64(k)


def build(item_ids: list, items: list[np.ndarray]) -> Block:
    begins = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    seeds, owner, at = [], [], []
    for i, x in enumerate(items):
        found = [_seed(x, k) for k in range(len(MASKS))] if len(x) >= LEAST else [tx.window_hash(x, len(x))] if len(x) else []
        for h in found:
            seeds.append(h)
            owner.append(np.full(len(h), i))
            at.append(np.arange(len(h)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    s = join(seeds, np.uint64)
    order = np.argsort(s, kind="stable")
    marks = np.zeros(1 << 24, bool)
    marks[(s & tx.U64((1 << 24) - 1)).astype(np.int64)] = True
    widths = sorted({len(x) for x in items if 0 < len(x) < LEAST})
    return Block(item_ids, join(items, np.uint64), begins, s[order], join(owner, np.int64)[order], join(at, np.int64)[order], marks, widths)


def _best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Score and bounds of the best stretch, +1 where equal and -1 elsewhere."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    start = int(total[: end + 1].argmin())
    return int(gain[end]), start, end


def _scored(block: Block, hashes: np.ndarray, before: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The distinct alignments (doc, item, shift) whose best stretch scores enough."""
    order = np.lexsort((shift, item, doc))
    rows = np.stack([doc[order], item[order], shift[order]]).astype(np.int64)
    rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])[: rows.shape[1]]]
    out = []
    d, i, s = rows
    size = block.begins[i + 1] - block.begins[i]
    upto = np.cumsum(np.minimum(s + size, before[d + 1]) - np.maximum(s, before[d]))
    cuts = [0]
    while cuts[-1] < len(upto):  # parts of about 4 * _HITS words
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, (upto[cuts[-1] - 1] if cuts[-1] else 0) + 4 * _HITS, "right"))))
    for at, end in zip(cuts, cuts[1:]):
        d, i, s = part = rows[:, at:end]
        size = block.begins[i + 1] - block.begins[i]
        lo, hi = np.maximum(s, before[d]), np.minimum(s + size, before[d + 1])
        n = hi - lo  # at least the words of the seed
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - first[owner]
        equal = hashes[lo[owner] + inside] == block.words[(block.begins[i] + lo - s)[owner] + inside]
        total = np.cumsum(np.where(equal, 1, -1))
        start = np.concatenate([[0], total])[first]  # the total before each alignment
        run = total - start[owner]
        drop = owner * (2 * int(n.max()) + 2)  # makes each alignment start below all before it
        low = np.minimum.accumulate(np.minimum(run - np.where(equal, 1, -1), 0) - drop) + drop
        gain = np.maximum.reduceat(run - low, first)
        out.append(part[:, gain >= np.minimum(LEAST, size)])
    return np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)


def overlaps(block: Block, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first word, end word, equal words) of the verified overlaps; one per document and item."""
    low = tx.lower(raw)
    starts, ends, before = tx.words(low, offsets, tx.NOT_ALNUM)
    hashes = tx.span_hash(low, starts, ends)
    kept = []
    for k in [*range(len(MASKS)), *[-w for w in block.short_widths]]:
        h = _seed(hashes, k) if k >= 0 else tx.window_hash(hashes, -k)
        at = np.flatnonzero(block.marks[(h & tx.U64((1 << 24) - 1)).astype(np.int64)])
        left = np.searchsorted(block.seeds, h[at], "left")
        count = np.searchsorted(block.seeds, h[at], "right") - left
        upto = np.cumsum(count)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - count[lo] + _HITS, "right")))
            c = count[lo:hi]
            place = np.repeat(at[lo:hi], c)
            row = np.repeat(left[lo:hi] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            item = block.seed_item[row]
            kept.append(_scored(block, hashes, before, np.searchsorted(before, place, "right") - 1, item, place - block.seed_at[row]))
            lo = hi
    doc, item, shift = np.concatenate(kept, 1) if kept else np.zeros((3, 0), np.int64)
    if not len(doc):
        return []
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, i, s in sorted(set(zip(doc.tolist(), item.tolist(), shift.tolist()))):
        size = int(block.begins[i + 1] - block.begins[i])
        lo, hi = max(s, int(before[d])), min(s + size, int(before[d + 1]))
        if hi <= lo:
            continue
        equal = hashes[lo:hi] == block.words[block.begins[i] + lo - s : block.begins[i] + hi - s]
        score, a, b = _best_stretch(equal)
        if score >= min(LEAST, size) and score > found.get((d, i), (0,))[0]:
            found[d, i] = (score, lo + a - int(before[d]), lo + b - int(before[d]), int(equal[a:b].sum()))
    return [(d, i, *v[1:]) for (d, i), v in found.items()]


def blocks(benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> tuple[int, Iterator[Block]]:
    """How many blocks of about ``block_seeds`` seeds the benchmark has, and the blocks, built one at a time."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                low = tx.lower(raw)
                starts, ends, before = tx.words(low, offsets, tx.NOT_ALNUM)
                h = tx.span_hash(low, starts, ends)
                packed = pa.array([h[i:j].tobytes() for i, j in zip(before[:-1], before[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["item_id"].slice(lo, hi - lo).cast(pa.int64()), packed], ["item_id", "words"])

    items = written(benchmark.select("item_id", "text").mapInArrow(hashed, "item_id long, words binary"), "benchmark-words")
    size = items.agg(F.coalesce(F.sum(F.length("words") / 8 * len(MASKS)), F.lit(0)).alias("seeds"), F.count("*").alias("items")).first()
    n = max(1, min(-(-int(size.seeds) // block_seeds), size.items))

    def built() -> Iterator[Block]:
        for k in range(n):
            rows = items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k).collect()
            if n > 1 and not rows:
                continue
            yield build([r["item_id"] for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows])
        discard(items)

    return n, built()


def _scan(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            ids = batch["doc_id"]
            for lo, _, raw, offsets in tx.slices(batch["text"]):
                rows = overlaps(block, raw, offsets)
                if rows:
                    d, i, a, b, n = (list(c) for c in zip(*rows))
                    columns = [ids.take(pa.array([lo + x for x in d])).cast(pa.int64()), pa.array([block.item_ids[x] for x in i], pa.int64())]
                    columns += [pa.array(c, pa.int64()) for c in (a, b, n)] + [pa.array([True] * len(d))]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _left(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, raw, offsets in tx.slices(batch["text"]):
                keep[[lo + r[0] for r in overlaps(shared.value, raw, offsets)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """A row for each document and benchmark item that overlap: where, and how many words are equal."""
    n, found = blocks(benchmark, block_seeds)
    send = docs.sparkSession.sparkContext.broadcast
    if n == 1:
        return [_scan(docs, send(block)) for block in found][0]
    parts = []
    for block in found:
        shared = send(block)
        parts.append(written(_scan(docs, shared), "overlaps"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no item."""
    n, found = blocks(benchmark, block_seeds)
    send = docs.sparkSession.sparkContext.broadcast
    if n == 1:
        return [_left(docs, send(block)) for block in found][0]
    left = None
    for block in found:
        shared = send(block)
        kept = written(_left(docs if left is None else left, shared), "uncontaminated")
        shared.destroy()
        if left is not None:
            discard(left)
        left = kept
    return left
