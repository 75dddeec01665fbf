"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes cuts texts wherever its top bits are zero, so an insertion moves
only the cuts near it. Chunks are deduplicated by digest: of equal chunks, the one of the smallest
doc_id (null last), then the first in its text, stays. Runs of removable chunks that touch count
only from LEAST_RUN bytes on, so phrases that recur by chance stay.

A common chunk is combined before the shuffle: within a slice of some megabytes all but the first are settled, and a task
remembers the first of up to REMEMBERED chunks, so later ones are settled as well and dealt anywhere.

Defined results: a null or empty text has no chunks; rows with equal doc_id and text are one document
and lose the same spans; very long texts are chunked whole; chunks never cross documents or split a character; ties of doc_id go by text hash,
then place; an empty table gives no rows. Columns of ``docs`` other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.store import written

#: 2**CUT_BITS bytes is the mean chunk.
CUT_BITS, LEAST_RUN = 5, 96
REMEMBERED = 1 << 19
_REACH = 32
_GEAR = np.random.default_rng(23).integers(0, 1 << 32, 256, dtype=np.uint32)
_CHUNK = "v long, w long, size int, none boolean, doc_id long, key long, start long, sure boolean"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, text string"


def gear(raw: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear(raw[i - j]) << j for j < 32, modulo 2**32, by doubling the reach."""
    h = _GEAR[raw]
    reach = 1
    while reach < _REACH:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and document of each chunk."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ends = np.flatnonzero(gear(raw) >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends = ends[ends < n]
    ends = ends[(raw[ends] & 0xC0) != 0x80]
    ends = ends[ends - offsets[np.searchsorted(offsets, ends - 1, "right") - 1] >= _REACH]
    left = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], ends]))
    right = np.append(left[1:], n)
    return left, right, np.searchsorted(offsets, left, "right") - 1


def _chunk_rows(docs: DataFrame) -> DataFrame:
    """Chunks with a digest (v, w) of two independent hashes of 64 bits; ``sure`` ones have an earlier equal in their task, and digests of no meaning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(REMEMBERED, np.int64) for c in ("v", "w", "none", "doc_id", "key", "start")}
        held["none"][:] = 2  # no chunk yet
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                ids = batch["doc_id"].slice(lo, hi - lo)
                left, right, doc = chunks(raw, offsets)
                if not len(left):
                    continue
                own = {"v": tx.span_hash(raw, left, right).view(np.int64), "w": tx.span_hash(raw, left, right, 1).view(np.int64)}
                own["none"] = np.asarray(ids.is_null()).astype(np.int64)[doc]
                own["doc_id"] = np.asarray(ids.fill_null(0)).astype(np.int64)[doc]
                own["key"], own["start"] = batch["key"].slice(lo, hi - lo).to_numpy()[doc], left - offsets[doc]
                order = np.lexsort((own["start"], own["key"], own["doc_id"], own["none"], own["w"], own["v"]))
                at = {c: x[order] for c, x in own.items()}
                first = np.ones(len(order), bool)
                first[1:] = (at["v"][1:] != at["v"][:-1]) | (at["w"][1:] != at["w"][:-1])
                head = np.flatnonzero(first)[np.cumsum(first) - 1]
                sure = (at["doc_id"] != at["doc_id"][head]) | (at["none"] != at["none"][head]) | (at["key"] != at["key"][head]) | (at["start"] != at["start"][head])
                one = np.flatnonzero(first)
                slot = at["v"][one] & (REMEMBERED - 1)
                known = (held["v"][slot] == at["v"][one]) & (held["w"][slot] == at["w"][one]) & (held["none"][slot] < 2)
                earlier, same = np.zeros(len(one), bool), known.copy()
                for c in ("none", "doc_id", "key", "start"):
                    earlier |= same & (held[c][slot] < at[c][one])
                    same &= held[c][slot] == at[c][one]
                sure[one] |= earlier
                fresh = one[~earlier]
                for c, x in held.items():
                    x[at["v"][fresh] & (REMEMBERED - 1)] = at[c][fresh]
                spread = tx.mix((at["key"] ^ at["start"]).view(np.uint64)).view(np.int64)
                none = at["none"].astype(bool)
                columns = [np.where(sure, spread, at["v"]), np.where(sure, 0, at["w"]), (right - left).astype(np.int32)[order], none, pa.array(at["doc_id"], mask=none), at["key"], at["start"], sure]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _CHUNK.split(", ")])

    return keyed(docs).mapInArrow(run, _CHUNK)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text: with doc_id, what rows of one document share."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): start and size of the chunks of each document that have an earlier equal."""
    rows = _chunk_rows(docs)
    place = Window.partitionBy("v", "w", "sure").orderBy("none", "doc_id", "key", "start")
    again = rows.withColumn("again", F.col("sure") | (F.rank().over(place) > 1)).filter("again")
    return again.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def without_repeats(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the text without repeated runs of chunks."""
    spans = written(repeated_chunks(docs), "chunk-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, runs, sizes = [], [], [], []
            for text, found in zip(batch["text"], batch["spans"].to_pylist()):
                raw = b"" if not text.is_valid else text.as_py().encode()
                pieces, at, n, k = [], 0, 0, 0
                for start, end in _runs(found or []):
                    if end - start >= least_run:
                        pieces.append(raw[at:start])
                        at, n, k = end, n + end - start, k + 1
                pieces.append(raw[at:])
                texts.append(b"".join(pieces).decode() if text.is_valid else None)
                removed.append(n)
                runs.append(k)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(texts, pa.string())], [c.split()[0] for c in _OUT.split(", ")])

    own = spans.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "spans")
    met = keyed(docs).join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    return met.select("doc_id", "text", "spans").mapInArrow(cut, _OUT)


def _runs(spans: list[dict]) -> list[tuple[int, int]]:
    """Chunks that touch, joined."""
    out: list[tuple[int, int]] = []
    for s in sorted((x["start"], x["start"] + x["size"]) for x in spans):
        if out and out[-1][1] == s[0]:
            out[-1] = (out[-1][0], s[1])
        else:
            out.append(s)
    return out
