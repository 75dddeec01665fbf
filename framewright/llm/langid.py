"""Language identification by prediction by partial matching (PPM) over bytes.

Every language has a context tree: how often each byte follows each context of 0 to ORDER bytes. A byte costs -log2(count / (total + kinds)) in the longest
context that has it; every longer known context that has not costs an escape, -log2(left / (total + kinds)), where ``kinds`` is the number of
bytes kept for the context and ``left`` is ``kinds`` plus what its kept bytes don't account for. Below order 0 every byte costs 8 bits. The
statistics are frozen after training, so the code length of a text is exact, and the shortest one names its language.

1. Counts of all strings of ORDER + 1 bytes, a text being preceded by zero bytes, are combined where they are read and summed up over all
   training texts; shorter strings are their marginal sums. Everything counts; the tree then keeps the NODES most frequent strings
   of each order and language (ties by the bytes), so that its size does not depend on the corpus but on the number of languages.
2. As the statistics are frozen, the cost of each kept string in every language is worked out once. A byte of a text is one look-up of a row of
   costs; bytes whose string is not kept are looked up again one order below, escapes added.

Costs are whole multiples of 2^-16 bits, so sums don't depend on order and reruns agree. Defined results: ``und`` and score 0 where a text is null or
has no letter (Unicode L), or nothing was learned; ties go to the first language by code point; repeated rows are judged alike; very long texts are read
whole; an empty table gives no rows. ``score`` is the share of the best language if all were equally likely before. Columns other than
doc_id, text and (in training) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.store import discard, written

ORDER, NODES = 4, 1 << 16
UNIT = 1 << 16
_SLICE = 1 << 20
_OUT = "doc_id long, lang_pred string, score double, bits array<double>"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Level(NamedTuple):
    """Kept strings of one order, ascending, their costs in every language; contexts of that order, their escapes."""

    strings: np.ndarray
    costs: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


class Model(NamedTuple):
    langs: list[str]
    levels: list[Level]


def strings(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the ``order`` bytes before it in its text (zero bytes before the text) as a number."""
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = raw.astype(np.int64)
    for k in range(1, order + 1):
        before = np.zeros(len(raw), np.int64)
        before[k:] = raw[:-k]
        before[place < k] = 0
        out |= before << (8 * k)
    return out


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, string, n) over all texts of docs(text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"], 2 * _SLICE):
                langs = batch["lang"].slice(lo, hi - lo).dictionary_encode()
                own, names = np.repeat(langs.indices.to_numpy(), np.diff(offsets)), langs.dictionary
                found = strings(raw, offsets, order)
                for k in range(len(names)):
                    keys, n = np.unique(found[own == k] if len(names) > 1 else found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(keys), k))).cast(pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "string", "n"])

    rows = docs.filter("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def kept(counts: DataFrame, order: int = ORDER, nodes: int = NODES) -> DataFrame:
    """(order, lang, string, n, total): the ``nodes`` most frequent strings of each order, and the count of their context."""
    out = None
    for k in range(order, -1, -1):
        n = counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang", F.shiftright("string", 8))))
        by = [F.desc("n"), F.asc("string")]
        first = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("string"), F.lit(16))).orderBy(*by))
        n = n.withColumn("k", first).filter(F.col("k") <= nodes)  # at most 16 * nodes of a language go on
        n = n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("k") <= nodes)
        rows = n.select(F.lit(k).alias("order"), "lang", "string", "n", "total")
        out = rows if out is None else out.unionByName(rows)
        counts = counts.groupBy("lang", F.col("string").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("string")).agg(F.sum("n").alias("n"))
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def _unit(bits: np.ndarray) -> np.ndarray:
    return np.rint(bits * UNIT).astype(np.int64)


def costs(levels: list[Level], keys: np.ndarray, n_langs: int, order: int) -> np.ndarray:
    """Cost of the last byte of each string of ``order`` + 1 bytes in every language."""
    if order < 0:
        return np.full((len(keys), n_langs), 8 * UNIT, np.int64)
    level = levels[order]
    at, there = _find(level.strings, keys)
    out = np.zeros((len(keys), n_langs), np.int64)
    out[there] = level.costs[at[there]]
    rest = np.flatnonzero(~there)
    if len(rest):
        known, found = _find(level.contexts, keys[rest] >> 8)
        below = costs(levels, keys[rest] & ((1 << (8 * order)) - 1), n_langs, order - 1)
        below[found] += level.escapes[known[found]]
        out[rest] = below
    return out


def model_of(rows: pa.Table, order: int = ORDER) -> Model:
    """The frozen trees with all costs worked out, from the rows of ``kept``."""
    name = np.array(rows["lang"].to_pylist(), dtype=object)
    langs = sorted(set(name))
    of = {x: i for i, x in enumerate(langs)}
    lang = np.array([of[x] for x in name], np.int64)
    at_order, string, n, total = (rows[c].to_numpy().astype(np.int64) for c in ("order", "string", "n", "total"))
    levels: list[Level] = []
    for k in range(order + 1):
        own = at_order == k
        unions, contexts = np.unique(string[own]), np.unique(string[own] >> 8)
        table = np.zeros((len(unions), len(langs)), np.int64)
        escapes = np.zeros((len(contexts), len(langs)), np.int64)
        below = costs(levels, unions & ((1 << (8 * k)) - 1), len(langs), k - 1)
        for i in range(len(langs)):
            mine = own & (lang == i)
            s, c, t = string[mine], n[mine], total[mine]
            ctx, first, which, kinds = np.unique(s >> 8, return_index=True, return_inverse=True, return_counts=True)
            seen = np.bincount(which, c, len(ctx))
            whole = t[first] + kinds
            at = np.searchsorted(contexts, ctx)
            escapes[at, i] = _unit(-np.log2((t[first] - seen + kinds) / whole))
            table[:, i] = below[:, i] + escapes[np.searchsorted(contexts, unions >> 8), i]
            table[np.searchsorted(unions, s), i] = _unit(-np.log2(c / whole[which]))
        levels.append(Level(unions, table, contexts, escapes))
    return Model(langs, levels)


def train(docs: DataFrame, order: int = ORDER, nodes: int = NODES) -> Model:
    """The trees of all languages in docs(text, lang). The driver gets (order + 1) * nodes rows a language at most."""
    counts = written(counted(docs, order), "strings")
    model = model_of(kept(counts, order, nodes).toArrow(), order)
    discard(counts)
    return model


class Lookup:
    """Rows of costs of the longest kept strings by a hash table; the few that share a slot are searched."""

    def __init__(self, model: Model):
        self.model, top = model, model.levels[-1]
        self.order = len(model.levels) - 1
        self.bits = max(8, int(len(top.strings)).bit_length() + 2)
        slot = self._slot(top.strings)
        self.keys, self.rows = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.keys[slot], self.rows[slot] = top.strings, np.arange(len(top.strings), dtype=np.int32)
        self.costs = top.costs.astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * tx.U64(0x9E3779B97F4A7C15)) >> tx.U64(64 - self.bits)).astype(np.int64)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in every language, in UNITs of a bit."""
        keys = strings(raw, offsets, self.order)
        slot = self._slot(keys)
        out = self.costs[self.rows[slot]] if len(self.costs) else np.zeros((len(keys), len(self.model.langs)), np.int32)
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            found, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = costs(self.model.levels, found, len(self.model.langs), self.order)[back]
        sums = np.zeros((len(offsets) - 1, len(self.model.langs)), np.int64)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            sums[full] = np.add.reduceat(out, offsets[full], axis=0, dtype=np.int64)
        return sums


def has_letter(texts: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.zeros(len(offsets) - 1, bool)
    found[np.searchsorted(offsets, np.flatnonzero(_ASCII_LETTER[raw]), "right") - 1] = True
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, and the code lengths in bits, by language in order of code point."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        look = Lookup(found) if found.langs else None
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"], _SLICE):
                ok = has_letter(batch["text"].slice(lo, hi - lo), raw, offsets)
                names, score, bits = ["und"] * (hi - lo), np.zeros(hi - lo), np.zeros((hi - lo, len(found.langs)))
                if look:
                    units = look(raw, offsets)
                    best = units.argmin(1)
                    score = np.where(ok, 1 / np.exp2(-np.minimum((units - units.min(1, keepdims=True)) / UNIT, 1000)).sum(1), 0)
                    names = [found.langs[k] if o else "und" for k, o in zip(best.tolist(), ok.tolist())]
                    bits = units / UNIT
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(found.langs)), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score), lists], ["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by crc32 of doc_id; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
