"""Periodic run detection: stretches of words that repeat with a period, by suffix trees.

A run is a stretch of words with smallest period q, at least 4 * q and at least 6 words long, that no neighbouring word extends.

1. A run makes every triple of words in all but its last q + 2 places come again at most q words later. Places where that can't hold, in the
   blocks that remain after each cut, are taken away until nothing changes; a text without such blocks has no run. No run is lost.
2. The words of each block left over, and of the reach of its longest possible run, get a suffix tree (Ukkonen), and one of their reversal. An Euler tour
   of the tree and a table of least depths give the longest common extension of two places at once.
3. Roots of runs are Lyndon words of the order of words or of its reverse: for each place the two longest ones, read from the ranks
   of the suffixes. Each root is extended in both directions.

Words are ``[^\\x20\\x09-\\x0D]+``, identified within a text by 64-bit hashes. Defined results: a null text has no words and stays null; an empty one
has no runs; rows are judged one by one, so repeated rows and a null doc_id are fine; ties keep every run; very long texts are read whole, a
block of a million words takes some 500 MB in its task; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import text as tx

PERIODS, LEAST = 4, 6
_SLICE = 1 << 22
_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """First and end symbol of the edge into each node, and children by node * alphabet + symbol, online (Ukkonen).

    ``s`` ends with 0, which is nowhere else.
    """
    n, width = len(s), max(s) + 1
    first, end, link, child = [0], [0], [0], {}
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        open_node = 0
        while rest:
            if not length:
                edge = i
            key = node * width + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                end.append(n)
                link.append(0)
                if open_node:
                    link[open_node] = node
                open_node = node
            else:
                size = min(end[below], i + 1) - first[below]
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                at = first[below]
                if s[at + length] == c:
                    length += 1
                    if open_node:
                        link[open_node] = node
                    break
                split = len(first)
                first += (at, i)
                end += (at + length, n)
                link += (0, 0)
                child[key] = split
                first[below] = at + length
                child[split * width + s[at + length]] = below
                child[split * width + c] = split + 1
                if open_node:
                    link[open_node] = split
                open_node = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return first, end, child


class Extensions:
    """Longest common extensions of the suffixes of ``s`` in constant time, and ``rank``: the suffixes in order."""

    def __init__(self, s: list[int]):
        n, width = len(s), max(s) + 1
        first, end, child = suffix_tree(s)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        parent = keys[order] // width
        below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        at = np.searchsorted(parent, np.arange(len(first) + 1)).tolist()
        stop, depth = at[1:], [0] * len(first)
        tour: list[int] = []
        place, rank, known = [0] * n, [0] * n, 0
        path = [0]
        while path:
            node = path[-1]
            tour.append(depth[node])
            k = at[node]
            if k == stop[node]:
                path.pop()
                continue
            at[node] = k + 1
            down = below[k]
            depth[down] = size = depth[node] + end[down] - first[down]
            if at[down] == stop[down]:
                place[n - size] = len(tour)
                tour.append(size)
                rank[n - size] = known
                known += 1
            else:
                path.append(down)
        self.rank, self.place = rank, np.array(place)
        self.least = [np.array(tour, np.int32)]
        step = 1
        while 2 * step <= len(tour):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j`` (never equal) share: the depth of the lowest node above both."""
        a, b = self.place[i], self.place[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out


def _next(rank: list[int], greater: bool) -> np.ndarray:
    """For each place the next one of less (or greater) rank; itself if there is none."""
    out, stack = list(range(len(rank))), []
    for j, r in enumerate(rank):
        while stack and (rank[stack[-1]] < r) == greater:
            out[stack.pop()] = j
        stack.append(j)
    return np.array(out)


def runs_of(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of at least PERIODS periods and LEAST words, in order."""
    n = len(words)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    symbol = np.unique(words, return_inverse=True)[1] + 1
    ahead = Extensions([*symbol.tolist(), 0])
    roots = []
    for greater in (False, True):
        j = _next(ahead.rank, greater)[:n]
        i = np.flatnonzero((j > np.arange(n)) & (j < n))
        i = i[symbol[i] == symbol[j[i]]]
        roots.append(np.stack([i, j[i]], 1))
    i, j = np.concatenate(roots).T
    ahead_of = ahead(i, j)
    del ahead
    back = Extensions([*symbol[::-1].tolist(), 0])
    before = np.zeros(len(i), np.int64)
    inner = i > 0
    before[inner] = back(n - i[inner], n - j[inner])
    runs = np.stack([i - before, j + ahead_of - i + before, j - i], 1)
    runs = runs[runs[:, 1] >= np.maximum(LEAST, PERIODS * runs[:, 2])]
    return np.unique(runs, axis=0)[:, :] if len(runs) else runs


def suspects(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(document, first word, end word) of the stretches outside of which there is no run; words by hash, before[i] of them before document i."""
    size = np.diff(before)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(doc)) + 3 <= before[doc + 1]) if len(doc) else np.zeros(0, np.int64)
    key = (tx.window_hash(hashes, 3)[at] if len(at) else np.zeros(0, np.uint64)) + tx.mix(doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = np.full(len(doc) + 1, 1 << 40)
    gap[at[order[:-1][same]]] = at[order[1:][same]] - at[order[:-1][same]]
    on = gap < 1 << 40
    while True:
        edges = np.flatnonzero(np.diff(on, prepend=False))
        first, end = edges[::2], edges[1::2]
        length = end - first
        fits = on.copy()
        fits[on] = (3 * gap[on] - 2 <= np.repeat(length, length)) & (np.repeat(length, length) >= 3)
        if fits.sum() == on.sum():
            break
        on = fits
    own = doc[first] if len(first) else np.zeros(0, np.int64)
    reach = (length + 2) // 3 + 4
    return np.stack([own, np.maximum(first - 1, before[own]), np.minimum(end - 1 + reach, before[own + 1])], 1)


def _runs(hashes: np.ndarray, before: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each document that has any; word numbers start at 0 in each document."""
    found: dict[int, set] = {}
    for doc, lo, hi in suspects(hashes, before).tolist():
        for start, length, period in runs_of(hashes[lo:hi]).tolist():
            cut = (start == 0 and lo > before[doc]) or (start + length == hi - lo and hi < before[doc + 1])
            if not cut:  # a run that goes on beyond this stretch lies inside another one
                found.setdefault(doc, set()).add((start + lo - int(before[doc]), length, period))
    return {d: sorted(x, key=lambda r: (r[0], r[2])) for d, x in found.items()}


def _collapsed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes and offsets."""
    use = np.zeros(len(raw), bool)
    use[tx.inked(raw)] = np.repeat(keep, ends - starts)
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(before, kept, "right") - 1
    gap = ends[kept[:-1][doc[1:] == doc[:-1]]]
    raw = raw.copy()
    raw[gap] = 32
    use[gap] = True
    return raw[use], np.concatenate([[0], np.cumsum(use)])


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words), and the text whose runs are cut to their first period, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"], _SLICE):
                starts, ends, before = tx.words(raw, offsets)
                found = _runs(tx.span_hash(raw, starts, ends), before)
                keep = np.ones(len(starts), bool)
                for doc, runs in found.items():
                    for start, length, period in runs:
                        keep[before[doc] + start + period : before[doc] + start + length] = False
                out, upto = _collapsed(raw, starts, ends, before, keep)
                at = upto[offsets]
                whole = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out.tobytes()))
                null = batch["text"].slice(lo, hi - lo).is_null()
                texts = pa.compute.if_else(null, pa.scalar(None, pa.large_string()), whole).cast(pa.string())
                lists = [[dict(zip(("start", "length", "period"), r)) for r in found.get(d, [])] for d in range(hi - lo)]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(before).astype(np.int64)), pa.array(lists, kind), texts], [c.split()[0] for c in ("doc_id", "n_words", "runs", "text")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def strongest(runs: Column) -> Column:
    """The run that repeats most often (exact length over period), then the first, then that of the least period; null without a run."""
    def better(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))

    return F.aggregate(F.slice(runs, F.lit(2), F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
