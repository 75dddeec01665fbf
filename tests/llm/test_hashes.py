"""Texts arranged so that sums modulo 2^64 cancel out: two letters in the Thue-Morse order, and the same with the letters swapped."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import chunkdedup, linededup, neardup, quality, text


def _orders(n):
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    return bits, 1 - bits


def _texts(n, a="b", b="c"):
    return ["".join((a, b)[i] for i in bits) for bits in _orders(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_hashes_of_arranged_bytes_and_words_differ(n):
    raw = np.frombuffer("".join(_texts(n)).encode(), np.uint8)
    for seed in (0, 1):
        one, two = text.span_hash(raw, np.array([0, n]), np.array([n, 2 * n]), seed)
        assert one != two
    values = np.concatenate([np.where(bits, 12, 34) for bits in _orders(n)]).astype(np.uint64)
    one, two = text.run_hash(values, np.array([0, n, 2 * n]))
    assert one != two


def test_equal_spans_hash_alike_anywhere():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 99, 3000).astype(np.uint8)
    for size in (0, 1, 7, 8, 9, 31, 32, 33, 64, 1000, 3000):
        raw = np.concatenate([np.zeros(5, np.uint8), body[:size], np.full(3, 98, np.uint8), body[:size]])
        one, two = text.span_hash(raw, np.array([5, 8 + size]), np.array([5 + size, 8 + 2 * size]))
        assert one == two


def test_op8_keeps_a_text_without_a_copy(spark):
    one, two = _texts(1024)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in chunkdedup.without_repeats(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 1024}


def test_op9_does_not_link_texts_without_a_common_shingle(spark):
    def doc(w):
        return " ".join(f"{w}{k}" for k in range(18))

    one, two = _texts(1024)
    docs = spark.createDataFrame([(1, doc(one)), (2, doc(two)), (3, doc(one))], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in neardup.classes(docs, width=3, percent=85).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_op1_counts_no_repeated_line():
    one, two = _texts(1024)
    raw, offsets = text.buffers(pa.array([f"{one}\n{two}", f"{one}\n{two}\n{one}"]))
    assert quality._scan(raw, offsets)["n_dup_lines"].tolist() == [0, 1]


def test_op6_cuts_long_texts_in_linear_time(spark):
    lines = [hashlib.sha256(str(i // 2).encode()).hexdigest()[:40] for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    r = linededup.without_repeated_lines(docs, counts=True).first()
    assert (r.n_lines, len(r.text.split("\n"))) == (60_000, 60_000 - r.n_removed) and r.n_removed == 30_000
