"""Toxicity: a convolutional text classifier over hashed word embeddings.

A token's embedding is the sum of those of its hash and the hashes of its first bytes. Filters of widths 1, 2
and 3 run over the tokens of a text; each filter's largest value feeds a logistic layer. It is
trained on all labelled rows, in passes: shards of them train copies of the model by themselves, and the mean of
their changes goes to the next pass; the threshold of each language is calibrated on a fifth of the labelled rows that training does not see. Language serves those thresholds only, not the score.

Defined results: a null or empty text has no tokens and gets the score of the bias and empty
filters; very long texts are scored whole; a null language uses the default threshold; repeated rows get equal results. Labels that
are null are not used; of repeated labels one counts, of rows that share a labelled doc_id the one with the least text;
an empty table gives no rows, and without labels every score is 0.5. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.store import BROADCAST_ROWS, agreed, discard, written

BUCKETS, DIM = 1 << 18, 8
WIDTHS, FILTERS = (1, 2, 3), 8
PREFIXES = (4, 5, 6)
#: Labelled documents in a shard, of which each trains by itself in a pass, and in a batch.
SHARD, BATCH = 4096, 32
#: A language has its own threshold if the calibration rows hold so many of either label.
LEAST_PER_LANGUAGE = 15
_BLOCK = 1 << 16  # tokens convolved at once


@dataclass
class Cnn:
    embed: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    shift: np.ndarray  # bias of each filter
    dense: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def token_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each token (one row each: whole, prefixes) and the number of tokens before each document."""
    raw = tx.lower(raw)
    starts, ends, before = tx.words(raw, offsets, tx.NOT_ALNUM)
    ids = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    ids[:, 0] = tx.span_hash(raw, starts, ends) % tx.U64(BUCKETS)
    for k, n in enumerate(PREFIXES):
        ids[:, k + 1] = (tx.span_hash(raw, starts, np.minimum(starts + n, ends)) + tx.U64(0x5851F42D4C957F2D * n & (1 << 64) - 1)) % tx.U64(BUCKETS)
    return ids, before


def _convolve(model: Cnn, ids: np.ndarray) -> np.ndarray:
    """Filter outputs at each token (windows start there); the caller masks windows that leave a document."""
    x = model.embed[ids].sum(1)
    out = np.empty((len(ids), len(WIDTHS) * FILTERS), np.float32)
    for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
        y = x @ f[0]
        for t in range(1, w):
            y[: len(y) - t] += (x @ f[t])[t:]
        out[:, k * FILTERS : (k + 1) * FILTERS] = y
    return out


def _room(before: np.ndarray) -> np.ndarray:
    """Tokens from each token to the end of its document."""
    return np.repeat(before[1:], np.diff(before)) - np.arange(before[-1])


def pooled(model: Cnn, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Largest output of each filter in each document; 0 where no window fits."""
    best = np.full((len(before) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    room = _room(before)
    for lo in range(0, len(ids), _BLOCK):
        hi = min(lo + _BLOCK, len(ids))
        y = _convolve(model, ids[lo : hi + WIDTHS[-1] - 1])[: hi - lo]
        for k, w in enumerate(WIDTHS):
            y[room[lo:hi] < w, k * FILTERS : (k + 1) * FILTERS] = -np.inf
        d = doc[lo:hi]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        best[d[first]] = np.maximum(best[d[first]], np.maximum.reduceat(y, first, axis=0))
    return np.where(np.isinf(best), 0, best)


def logits(model: Cnn, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.maximum(pooled(model, ids, before) + model.shift, 0) @ model.dense + model.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fresh(counts: np.ndarray, totals: np.ndarray, seed: int = 5) -> Cnn:
    """The model before training, from the documents of either label that hold a bucket (2 x BUCKETS) and all of either label.

    The first embedding dimension starts as the log odds of the buckets that several documents hold. Without rows of both labels it is a bias alone.
    """
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    embed = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    model = Cnn(embed, filters, np.zeros(n_out, np.float32), (rng.standard_normal(n_out) * 0.1).astype(np.float32), 0.0)
    if not totals.all():
        model.bias = 0.0 if not totals.any() else (3.0 if totals[1] else -3.0)
        model.dense[:] = 0
        return model
    odds = np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2))
    embed[:, 0] = np.where(counts.sum(0) >= 4, np.clip(odds, -1, 4), 0) / 2
    for f in filters:
        f[:, 0, 0] = 1
    model.dense[::FILTERS] = 1
    return model


class Trainer:
    """Adam on the logistic loss over batches of documents; through max pooling only the windows that won get a gradient."""

    def __init__(self, model: Cnn):
        self.model = Cnn(model.embed.copy(), [f.copy() for f in model.filters], model.shift.copy(), model.dense.copy(), 0.0)
        self.bias = np.full(1, model.bias, np.float32)
        self.touched = np.zeros(BUCKETS, bool)
        self.state: dict[str, list] = {}

    def _adam(self, name: str, p: np.ndarray, g: np.ndarray, rows=slice(None), rate: float = 0.02) -> None:
        m, v, k = self.state.setdefault(name, [np.zeros_like(p), np.zeros_like(p), 0])
        self.state[name][2] = k = k + 1
        m[rows] = 0.9 * m[rows] + 0.1 * g
        v[rows] = 0.99 * v[rows] + 0.01 * g * g
        p[rows] -= rate * (m[rows] / (1 - 0.9**k)) / (np.sqrt(v[rows] / (1 - 0.99**k)) + 1e-6)

    def step(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        model, n_out = self.model, len(WIDTHS) * FILTERS
        sizes = np.array([len(d) for d in docs])
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.concatenate(docs)
        out, room = _convolve(model, ids), _room(before)
        win = np.full((len(docs), n_out), -1)
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            out[room < w, cols] = -np.inf
            for d in np.flatnonzero(sizes >= w):
                win[d, cols] = before[d] + out[before[d] : before[d + 1], cols].argmax(0)
        value = np.where(win >= 0, np.take_along_axis(out, np.maximum(win, 0), 0) if len(out) else 0, 0) + model.shift
        hidden = np.maximum(value, 0)
        error = ((_sigmoid(hidden @ model.dense + self.bias[0]) - y) / len(docs)).astype(np.float32)
        back = error[:, None] * model.dense * (value > 0)
        g_filters = [np.zeros_like(f) for f in model.filters]
        rows, g_rows = [], []
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            d, f = np.nonzero((win[:, own] >= 0) & (back[:, own] != 0))
            weight, p = back[:, own][d, f][:, None], win[:, own][d, f]
            for t in range(w):
                at = ids[p + t]
                x = weight * model.embed[at].sum(1)
                for c in range(FILTERS):
                    g_filters[k][t, :, c] = x[f == c].sum(0)
                rows.append(at.ravel())
                g_rows.append(np.repeat(weight * model.filters[k][t].T[f], at.shape[1], axis=0))
        self._adam("dense", model.dense, hidden.T @ error + 1e-4 * model.dense)
        self._adam("bias", self.bias, error.sum(keepdims=True))
        self._adam("shift", model.shift, back.sum(0))
        for k, f in enumerate(model.filters):
            self._adam(f"filter{k}", f, g_filters[k] + 1e-4 * f, rate=0.01)
        touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        if len(touched):
            g = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g, inverse, np.concatenate(g_rows))
            self._adam("embed", model.embed, g, touched, rate=0.01)
            self.touched[touched] = True

    def small(self) -> np.ndarray:
        """All numbers but the embeddings."""
        return np.concatenate([*(f.ravel() for f in self.model.filters), self.model.shift, self.model.dense, self.bias]).astype(float)


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 32, seed: int = 5) -> Cnn:
    """The model trained on documents in memory."""
    counts = np.zeros((2, BUCKETS))
    for ids, label in zip(docs, y):
        counts[int(label), np.unique(ids)] += 1
    totals = np.array([(~y).sum(), y.sum()])
    trainer = Trainer(fresh(counts, totals, seed))
    rng = np.random.default_rng(seed)
    for _ in range(epochs if totals.all() else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            trainer.step([docs[i] for i in order[at : at + batch]], y[order[at : at + batch]])
    trainer.model.bias = float(trainer.bias[0])
    return trainer.model


_PARTS = 16


def _sparse(first: int, total: np.ndarray) -> pa.RecordBatch:
    """The rows of ``total`` that are not all zero, dealt to parts."""
    at = np.flatnonzero(total.any(1)).astype(np.int32)
    own = [at[at % _PARTS == k] for k in range(_PARTS)]
    columns = [pa.array(range(_PARTS), pa.int32()), pa.array([first] * _PARTS, pa.int32()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([total[x].tobytes() for x in own], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "first", "at", "total"])


def _added(df: DataFrame, tasks, size: int, width: int) -> np.ndarray:
    """The sum of what ``tasks`` makes of the partitions of ``df``: ``size`` x ``width`` numbers, added up by parts of the rows."""

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by([("first", "ascending")])
        total = np.zeros((size, width))
        for at, own in zip(t["at"], t["total"]):
            total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(own.as_buffer()).reshape(-1, width)
        whole = _sparse(0, total)
        return pa.Table.from_batches([whole.take(pa.array([t["part"][0].as_py()]))])

    schema = "part int, first int, at binary, total binary"
    total = np.zeros((size, width))
    for r in df.mapInArrow(tasks, schema).groupBy("part").applyInArrow(add, schema).toArrow().to_batches():  # of fixed size
        for at, own in zip(r["at"], r["total"]):
            total[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(own.as_buffer()).reshape(-1, width)
    return total


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(shard, label, buckets of its tokens) of each row."""
    for batch in batches:
        shards, y = batch["shard"].to_pylist(), batch["toxic"].to_pylist()
        for lo, hi, raw, offsets in tx.slices(batch["text"]):
            ids, before = token_ids(raw, offsets)
            for k in range(lo, hi):
                yield shards[k], y[k], ids[before[k - lo] : before[k - lo + 1]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a bucket; the last row: all of them."""
    total, first = np.zeros((BUCKETS + 1, 2)), -1
    for shard, label, ids in _documents(batches):
        first = shard if first < 0 else first
        total[np.unique(ids), int(label)] += 1
        total[BUCKETS, int(label)] += 1
    yield _sparse(first, total)


def _epoch(table: DataFrame, model: Cnn) -> Cnn:
    """``model`` after one pass over ``table``: every shard trains it by itself, then each number changes by the mean of the shards that changed it."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size: BUCKETS x DIM floats
    start = Trainer(model).small()
    size = BUCKETS + len(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total, first = shared.value, np.zeros((size, DIM + 1)), -1
        for shard, rows in groupby(_documents(batches), lambda r: r[0]):
            first = shard if first < 0 else first
            trainer = Trainer(base)
            while some := list(islice(rows, BATCH)):
                trainer.step([ids for _, _, ids in some], np.array([label for _, label, _ in some], bool))
            t = np.flatnonzero(trainer.touched)
            total[t, :DIM] += trainer.model.embed[t] - base.embed[t]
            total[t, DIM] += 1
            total[BUCKETS:, 0] += trainer.small() - start
            total[BUCKETS:, DIM] += 1
        yield _sparse(first, total)

    total = _added(table, run, size, DIM + 1)
    shared.unpersist()
    change = total[:, :DIM] / np.maximum(total[:, DIM:], 1)
    numbers = np.split((start + change[BUCKETS:, 0]).astype(np.float32), np.cumsum([*(f.size for f in model.filters), model.shift.size, model.dense.size]))
    filters = [n.reshape(f.shape) for n, f in zip(numbers, model.filters)]
    return Cnn((model.embed + change[:BUCKETS]).astype(np.float32), filters, numbers[-3], numbers[-2], float(numbers[-1][0]))


_GRID = np.linspace(0.05, 0.95, 91)


def calibrate(table: DataFrame, model: Cnn) -> dict[str, float]:
    """Per language, the middle of the range of thresholds that make the fewest errors on the rows (text, lang, toxic); '' is for all others."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                p = _sigmoid(logits(shared.value, *token_ids(raw, offsets)).astype(float))
                passed = pa.array(np.searchsorted(_GRID, p, "right").astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch[c].slice(lo, hi - lo) for c in ("lang", "toxic")] + [passed], ["lang", "toxic", "passed"])

    counts = written(table.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic boolean, passed int").groupBy("lang", "toxic", "passed").count(), "calibration")
    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("count")).otherwise(0))
    able = counts.filter("lang <> ''").groupBy("lang").agg(F.least(of(True), of(False)).alias("n")).filter(F.col("n") >= LEAST_PER_LANGUAGE).select("lang")
    every = counts.groupBy(F.lit("").alias("lang"), "toxic", "passed").agg(F.sum("count").alias("count"))
    rows = every.unionByName(counts.join(able, "lang")).collect()  # two rows per threshold and language
    discard(counts)
    right = {r["lang"]: np.zeros((2, len(_GRID) + 1)) for r in rows}
    for r in rows:
        right[r["lang"]][int(r["toxic"]), r["passed"]] += r["count"]
    found = {"": 0.5}
    for lang, (clean, toxic) in sorted(right.items()):
        errors = np.cumsum(toxic)[:-1] + clean.sum() - np.cumsum(clean)[:-1]
        found[lang] = float(np.median(_GRID[errors == errors.min()]))
    return found


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD, epochs: int = 6) -> Cnn:
    """Fit on all labelled rows whose crc32(doc_id as text) mod 5 is not 0; a document labelled both ways is left out.

    A fifth of them, by crc32 of the letter c and the doc_id, calibrates the thresholds; the others are dealt to shards of about ``shard`` documents, in each
    of which every pass trains a copy of the model. A language with fewer than LEAST_PER_LANGUAGE calibration rows of either label gets the common threshold.
    """
    name = F.col("doc_id").cast("string")
    learn = labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(name) % 5 != 0)
    ids = agreed(learn.select("doc_id", F.expr("toxic > 0").alias("toxic")), "toxic")
    n = ids.count()
    ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
    found = docs.select("doc_id", "text", "lang").filter(F.crc32(name) % 5 != 0).join(ids, "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one"))
    place = F.crc32(F.concat(F.lit("c"), name))
    rows = found.select("doc_id", "toxic", "one.lang", "one.text", place.alias("place"))
    shards = max(1, -(-n // shard))
    rows = rows.withColumn("shard", F.when(F.col("place") % 5 == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")))
    rows = rows.withColumn("slot", F.when(F.col("shard") < 0, F.col("doc_id") % shards).otherwise(F.lit(0)))
    table = written(rows.repartition(shards + 1, "shard", "slot").sortWithinPartitions("shard", "place", "doc_id").drop("slot", "place", "doc_id"), "labelled")
    training = table.filter("shard >= 0").select("shard", "toxic", "text")
    counts = _added(training, _counted, BUCKETS + 1, 2)
    model = fresh(counts[:BUCKETS].T, counts[BUCKETS])
    for _ in range(epochs if counts[BUCKETS].all() else 0):
        model = _epoch(training, model)
    model.thresholds = calibrate(table.filter("shard < 0"), model)
    discard(table)
    return model


def score(docs: DataFrame, model: Cnn) -> DataFrame:
    """doc_id, score, and ``toxic``: whether the score reaches the threshold of the row's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        default = model.thresholds.get("", 0.5)
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                p = _sigmoid(logits(model, *token_ids(raw, offsets)).astype(float))
                limit = np.array([model.thresholds.get(x, default) for x in langs[lo:hi]])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo).cast(pa.int64()), pa.array(p), pa.array(p >= limit)], ["doc_id", "score", "toxic"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, score double, toxic boolean")


def without_toxic(docs: DataFrame, model: Cnn) -> DataFrame:
    """The rows of ``docs``, all columns, whose text does not reach the threshold of its language."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        default = model.thresholds.get("", 0.5)
        for batch in batches:
            langs = batch["lang"].to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                p = _sigmoid(logits(model, *token_ids(raw, offsets)).astype(float))
                keep[lo:hi] = p < np.array([model.thresholds.get(x, default) for x in langs[lo:hi]])
            yield batch.filter(pa.array(keep))

    return docs.select(*names).mapInArrow(run, docs.schema)
