"""Quality rules: a linear-chain conditional random field over the lines of a text.

Each line with a word becomes a vector of layout features. A two-state chain (boilerplate,
content), trained in numpy, is decoded by Viterbi; the share of words in content lines decides
whether the text stays. Counting rules on words and repeated windows come before it.

Defined results: a null or empty text has no words, fails the counting rules and is not kept.
Rows are judged one by one, so repeated rows get equal results. Columns of ``docs`` other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.store import agreed

SYMBOLS = b"#*$%&|<>"
N_FEATURES = 14
#: Training reads at most so many labelled rows of either label.
SAMPLE_PER_LABEL = 1500
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, content_words long, content_share double, line_labels string"
)

_CLASS = np.zeros((5, 256), np.int8)
_CLASS[0, list(SYMBOLS)] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, 65:91] = 1
_CLASS[3, list(b".,;:!?")] = 1
_CLASS[4, 128:192] = 1  # continuation bytes: code points = bytes - these
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;\"')")] = True


@dataclass(frozen=True)
class Crf:
    """Emission weights of the state content (boilerplate scores 0), start and transition scores."""

    emission: np.ndarray
    start: np.ndarray
    move: np.ndarray


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where a value occurs more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _scan(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by document and features by line (lines without a word are left out)."""
    n = len(offsets) - 1
    starts, ends, before = tx.words(raw, offsets)
    hashes = tx.span_hash(raw, starts, ends)
    n_words = np.diff(before)
    doc = np.repeat(np.arange(n), n_words)
    sums = np.zeros((5, len(raw) + 1), np.int32)
    for k in range(5):
        np.cumsum(_CLASS[k][raw], out=sums[k, 1:], dtype=np.int32)
    code_points = (ends - starts) - (sums[4][ends] - sums[4][starts])
    out = {
        "n_words": n_words,
        "word_chars": np.bincount(doc, code_points, n).astype(np.int64),
        "n_symbols": np.diff(sums[0][offsets].astype(np.int64)),
    }

    covered = np.zeros(len(starts) + 1, np.int64)
    windows = tx.window_hash(hashes, 8)
    if len(windows):
        at = np.flatnonzero(doc[: len(windows)] == doc[7:])
        hit = at[_repeats(tx.mix(windows[at] + doc[at].astype(np.uint64) * tx.U64(0xD6E8FEB86659FD93)))]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 8, -1)
    out["n_repeat_words"] = np.bincount(doc, np.cumsum(covered)[:-1] > 0, n).astype(np.int64)

    breaks = np.flatnonzero(raw == 10)
    left = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    left = left[left < len(raw)]
    right = np.append(left[1:], len(raw))
    right = right - ((right > left) & (raw[np.maximum(right, 1) - 1] == 10)) if len(left) else right
    first = np.searchsorted(starts, left)
    count = np.searchsorted(starts, right) - first
    keep = count > 0
    left, right, first, count = left[keep], right[keep], first[keep], count[keep]
    line_doc = np.searchsorted(offsets, left, "right") - 1
    line_key = tx.mix(tx.span_hash(raw, left, right) + line_doc.astype(np.uint64) * tx.U64(0xD6E8FEB86659FD93))
    _, seen = np.unique(line_key, return_index=True)
    again = np.ones(len(left), bool)
    again[seen] = False
    out["n_dup_lines"] = np.bincount(line_doc, again, n).astype(np.int64)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[first + count] - total[first]

    size = np.maximum(right - left, 1)
    inked = np.maximum(per_line(ends - starts), 1)
    capital = (raw[starts] >= 65) & (raw[starts] < 91) if len(starts) else np.zeros(0, bool)
    stutter = np.zeros(len(starts), bool)
    stutter[1:] = hashes[1:] == hashes[:-1]
    short = (ends - starts) <= 1
    in_line = lambda k: (sums[k][right] - sums[k][left]).astype(float)
    words_per_point = count / (1.0 + in_line(3))
    x = np.zeros((len(left), N_FEATURES), np.float32)
    x[:, 0] = 1
    x[:, 1] = np.minimum(1, 5 * in_line(0) / inked)
    x[:, 2] = per_line(short) / count
    x[:, 3] = np.minimum(1, 5 * in_line(1) / inked)
    x[:, 4] = per_line(capital) / count
    x[:, 5] = _ENDS[raw[ends[first + count - 1] - 1]] if len(left) else 0
    x[:, 6] = np.minimum(1, np.log1p(count) / 6)
    x[:, 7] = count < 4
    x[:, 8] = per_line(stutter) / count
    x[:, 9] = np.minimum(2, inked / count / 10)
    x[:, 10] = np.minimum(1, np.log1p(words_per_point) / 5)
    x[:, 11] = again
    x[:, 12] = in_line(0) > 0
    x[:, 13] = np.minimum(1, (size - inked) / inked * 2)
    return out | {"x": x, "line_words": count, "lines": np.bincount(line_doc, minlength=n)}


def _padded(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling number of lines, and for each step how many are still running."""
    order = np.argsort(-lines, kind="stable")
    steps = int(lines.max()) if len(lines) else 0
    running = np.searchsorted(-lines[order], -np.arange(steps), "left")
    return order, running


def viterbi(model: Crf, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The best state of each line; ``lines`` is the number of lines of each document, in order."""
    emit = x @ model.emission
    base = np.concatenate([[0], np.cumsum(lines)])[:-1]
    order, running = _padded(lines)
    state = np.zeros(len(x), np.int8)
    back = np.zeros((len(x), 2), np.int8)
    score = np.zeros((len(lines), 2))
    for t, m in enumerate(running):
        at = base[order[:m]] + t
        if t == 0:
            score[:m] = model.start
        else:
            paths = score[:m, :, None] + model.move[None]
            back[at] = paths.argmax(1)
            score[:m] = paths.max(1)
        score[:m, 1] += emit[at]
    best = score.argmax(1).astype(np.int8)
    for t in range(len(running) - 1, -1, -1):
        m = running[t]
        at = base[order[:m]] + t
        state[at] = best[:m]
        best[:m] = back[at, best[:m]]
    return state


def _expected(model: Crf, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: probability of content by line, expected starts and moves."""
    emit = np.zeros((len(x), 2))
    emit[:, 1] = x @ model.emission
    base = np.concatenate([[0], np.cumsum(lines)])[:-1]
    order, running = _padded(lines)
    ahead = np.zeros((len(x), 2))
    for t, m in enumerate(running):
        at = base[order[:m]] + t
        if t == 0:
            ahead[at] = model.start + emit[at]
        else:
            ahead[at] = np.logaddexp.reduce(ahead[at - 1][:, :, None] + model.move[None], axis=1) + emit[at]
    behind = np.zeros((len(x), 2))
    moves = np.zeros((2, 2))
    total = np.zeros(len(lines))
    ends = base + lines - 1
    has = lines > 0
    total[has] = np.logaddexp.reduce(ahead[ends[has]], axis=1)
    for t in range(len(running) - 1, 0, -1):
        m = running[t]
        at = base[order[:m]] + t
        onward = model.move[None] + (emit[at] + behind[at])[:, None, :]
        behind[at - 1] = np.logaddexp.reduce(onward, axis=2)
        moves += np.exp(ahead[at - 1][:, :, None] + onward - total[order[:m], None, None]).sum(0)
    p = np.exp(ahead + behind - np.repeat(total, lines)[:, None])
    return p[:, 1], p[base[has]].sum(0), moves


def fit(x: np.ndarray, lines: np.ndarray, good: np.ndarray, rounds: int = 3, steps: int = 120) -> Crf:
    """Train on documents labelled good or bad as wholes.

    Lines of good documents are content. Lines of bad documents start as boilerplate; after each
    round those that the chain itself takes for content are relabelled.
    """
    if not len(x) or good.all() or not good.any():
        return Crf(np.eye(1, N_FEATURES)[0], np.zeros(2), np.zeros((2, 2)))
    good_line = np.repeat(good, lines)
    y = good_line.astype(np.int8)
    base = np.concatenate([[0], np.cumsum(lines)])[:-1]
    inside = np.ones(len(x), bool)
    inside[base[lines > 0]] = False
    model = Crf(np.zeros(N_FEATURES), np.zeros(2), np.zeros((2, 2)))
    n = len(x)
    for _ in range(rounds):
        theta = [model.emission, model.start, model.move]
        seen_start = np.bincount(y[base[lines > 0]], minlength=2)
        at = np.flatnonzero(inside)
        seen_move = np.bincount(y[at - 1] * 2 + y[at], minlength=4).reshape(2, 2)
        mean, square = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        for k in range(1, steps + 1):
            p, start, moves = _expected(Crf(*theta), x, lines)
            grads = [x.T @ (y - p) / n, (seen_start - start) / n, (seen_move - moves) / n]
            for i, g in enumerate(grads):
                g = g - 1e-4 * theta[i]
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                theta[i] = theta[i] + 0.2 * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-8)
        model = Crf(*theta)
        y = np.where(good_line, 1, viterbi(model, x, lines)).astype(np.int8)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Crf:
    """Fit on at most ``per_label`` labelled rows of each label, those of smallest hashed id; a document labelled both ways is left out."""
    ids = agreed(labels.filter("doc_id is not null and quality is not null").select("doc_id", F.expr("quality > 0").alias("good")), "good")
    parts = [ids.filter(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for g in (True, False)]
    wanted = parts[0].unionByName(parts[1])  # at most 2 * per_label rows: broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                found = _scan(raw, offsets)
                cut = np.split(found["x"], np.cumsum(found["lines"])[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), batch["good"].slice(lo, hi - lo), pa.array([c.tobytes() for c in cut], pa.binary())],
                    ["doc_id", "good", "x"],
                )

    rows = sorted(sample.select("doc_id", "good", "text").mapInArrow(lines_of, "doc_id long, good boolean, x binary").collect())
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(xs) if xs else np.zeros((0, N_FEATURES), np.float32)
    return fit(x.astype(float), np.array([len(v) for v in xs], np.int64), np.array([r["good"] for r in rows], bool))


def judge(docs: DataFrame, model: Crf, min_share: float = 0.5) -> DataFrame:
    """Counts, rules and line labels (C content, B boilerplate) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in tx.slices(batch["text"]):
                s = _scan(raw, offsets)
                state = viterbi(model, s["x"].astype(float), s["lines"])
                line_doc = np.repeat(np.arange(hi - lo), s["lines"])
                content = np.bincount(line_doc, s["line_words"] * state, hi - lo).astype(np.int64)
                share = content / np.maximum(s["n_words"], 1)
                failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
                letters = np.where(state == 1, ord("C"), ord("B")).astype(np.uint8).tobytes().decode()
                at = np.concatenate([[0], np.cumsum(s["lines"])])
                columns = [s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo).cast(pa.int64())]
                    + [pa.array(c.astype(np.int64)) for c in columns]
                    + [pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(s["lines"].astype(np.int64)), pa.array(content), pa.array(share)]
                    + [pa.array([letters[i:j] for i, j in zip(at[:-1], at[1:])], pa.string())],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
