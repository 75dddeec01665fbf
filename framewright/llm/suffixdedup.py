"""Suffix-array dedup: external induced sorting of shards.

A string of WIDTH bytes that starts at two places has the same minimizer (the least hash of its GRAM-byte pieces) at
both. So texts are cut into stretches of strings with one minimizer; stretches whose minimizer
occurs nowhere else hold no repeat and go no further. The others are dealt to shards by minimizer: equal
strings meet in one shard, which is sorted by ``induced.repeated_spans``. Equal stretches go there
once or twice, whatever their number.

Order beyond WIDTH bytes does not matter here, so the names of S*-substrings are refined by doubling up to
WIDTH in place of further levels of recursion; this part of a shard is held in memory.

Defined results: a null text counts as empty; texts shorter than WIDTH lose nothing; rows with
equal doc_id and text are separate documents (each is a copy of the other) and get equal results.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.induced import repeated_spans
from framewright.llm.store import written

WIDTH, GRAM = 200, 32
#: Bytes of stretches per shard, on average.
SHARD_BYTES = 4 << 20
_SEEN = 1 << 20
_KNOWN = 1 << 20  # flags by the last bits of minimizers
_STRETCH = "m long, key long, start long, size int, shared boolean, told boolean"
_STRING = "m long, key long, start long, name long, content binary, again boolean"


def _key() -> Column:
    """A hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key")


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks forwards and backwards."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    cells = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Minimizer, first byte, end byte, document of each maximal run of ``width``-byte strings with one
    minimizer, and whether that piece occurs twice within the run."""
    none = np.zeros(0, np.int64)
    nothing = none.astype(np.uint64), none, none, none, none.astype(bool)
    if len(raw) < width:
        return nothing
    pieces, span = tx.piece_hash(raw, gram), width - gram + 1
    least = _window_min(pieces, span)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + width <= offsets[doc + 1])
    if not len(start):
        return nothing
    new = np.ones(len(start), bool)
    new[1:] = (least[start[1:]] != least[start[:-1]]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(start)) - 1
    m, left, right = least[start[first]], start[first], start[final] + width
    kinds, kind = np.unique(m, return_inverse=True)
    known = np.zeros(_KNOWN, bool)
    known[kinds & tx.U64(_KNOWN - 1)] = True
    chosen = np.flatnonzero(pieces <= kinds[-1])
    chosen = chosen[known[pieces[chosen] & tx.U64(_KNOWN - 1)]]  # hardly any but the minimizers
    own = np.minimum(np.searchsorted(kinds, pieces[chosen]), len(kinds) - 1)
    fits = kinds[own] == pieces[chosen]
    places = np.sort(own[fits] * len(raw) + chosen[fits])
    times = np.searchsorted(places, kind * len(raw) + right - gram, "right") - np.searchsorted(places, kind * len(raw) + left)
    return m, left, right, doc[left], times > 1


def _stretches(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """All stretches. ``shared``: its minimizer occurs twice within it or some megabytes; ``told``: one row of those of a minimizer there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"], 1 << 20):
                m, left, right, doc, twice = stretches(raw, offsets, width, gram)
                keys = batch["key"].slice(lo, hi - lo).to_numpy()
                _, first, inverse, count = np.unique(m, return_index=True, return_inverse=True, return_counts=True)
                told = np.zeros(len(m), bool)
                told[first] = True
                columns = [m.view(np.int64), keys[doc], left - offsets[doc], (right - left).astype(np.int32), twice | (count[inverse] > 1) if len(m) else told, told]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _STRETCH.split(", ")])

    return docs.select(_key(), "text").mapInArrow(run, _STRETCH)


def _not_alone(rows: DataFrame) -> DataFrame:
    """Rows whose ``m`` at least two rows have; partitions are sorted and read as streams that remember one row."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch["m"].to_numpy()
            same = np.zeros(len(m) + 1, bool)
            same[1:-1] = m[1:] == m[:-1]
            same[0] = before is not None and m[0] == before
            if same[0] and waiting is not None:
                yield waiting
            keep = same[:-1] | same[1:]
            waiting = None if keep[-1] else batch.slice(len(m) - 1, 1)
            before = m[-1]
            yield batch.filter(pa.array(keep))

    return rows.repartition("m").sortWithinPartitions("m").mapInArrow(run, rows.select(*names).schema)


def _strings(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The bytes of the wanted stretches: a row each, with ``content`` the first time a task meets it,
    and a second time with ``again``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}
        for batch in batches:
            rows = []
            for text, key, found in zip(batch["text"], batch["key"].to_pylist(), batch["spans"].to_pylist()):
                raw = text.as_py().encode()
                for x in found:
                    content = raw[x["start"] : x["start"] + x["size"]]
                    name = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
                    times = seen.get(name)
                    if len(seen) > _SEEN:
                        seen.clear()
                    seen[name] = times is not None
                    rows.append((x["m"], key, x["start"], name, None if times else content, times is not None))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    names = [c.split()[0] for c in _STRING.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    wanted = spans.hint("shuffle_hash")  # texts are not sorted
    return docs.select(_key(), "text").join(wanted, "key").select("text", "key", "spans").mapInArrow(cut, _STRING)


def _sorted_shards(strings: DataFrame, shards: int, width: int) -> DataFrame:
    """(name, first, end) of the repeated spans of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents: dict[int, bytes] = {}
        many: set[int] = set()
        for batch in batches:
            for name, content, again in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), batch["again"].to_pylist()):
                if again or name in contents:
                    many.add(name)
                contents.setdefault(name, content)
        names = list(contents)
        # A stretch that occurs twice is a repeat as a whole; the sort finds what it shares with others.
        rows = [(names[i], a, b) for i, a, b in repeated_spans(list(contents.values()), width)]
        rows += [(name, 0, len(contents[name])) for name in many]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], ["name", "first", "end"])

    sent = strings.filter("content is not null").select("m", "name", "content", "again").repartition(shards, "m")
    return sent.select("name", "content", "again").mapInArrow(run, "name long, first long, end long")


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, cuts): spans of each document, by its hash _key, that ``width``-byte strings found twice cover."""
    all_rows = written(_stretches(docs, width, gram), "stretches")
    near = all_rows.filter("shared").select("m", "key", "start", "size")
    far = _not_alone(all_rows.filter("told").select("m", "key", "start", "size", "shared")).filter("not shared").drop("shared")
    spans = near.unionByName(far).groupBy("key").agg(F.collect_set(F.struct("m", "start", "size")).alias("spans"))
    strings = written(_strings(docs, spans), "stretch-bytes")
    n_bytes = strings.agg(F.sum(F.length("content"))).first()[0] or 0
    found = written(_sorted_shards(strings, max(1, -(-int(n_bytes) // shard_bytes)), width), "repeats")
    places = strings.select("key", "start", "name").join(found, "name")
    return places.groupBy("key").agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end"))).alias("cuts"))


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay."""
    cuts = written(repeated_bytes(docs, width, gram, shard_bytes), "cuts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch["doc_id"].to_pylist(), batch["text"], batch["cuts"].to_pylist()):
                raw = text.as_py().encode() if text.is_valid else b""
                pieces, at, removed, runs = [], 0, 0, 0
                for first, end in _joined(found or []):
                    pieces.append(raw[at:first])
                    at, removed, runs = end, removed + end - first, runs + 1
                pieces.append(raw[at:])
                rows.append((doc_id, len(raw), removed, runs, b"".join(pieces)))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), "text")
    return marked.join(cuts.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "cuts").mapInArrow(cut, schema)


def _joined(cuts: list[dict]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((x["first"], x["end"]) for x in cuts):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out
