"""Periodic runs against brute force: random word sequences, planted periods, nulls, long texts, the registered query."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import queries, runs
from tests.llm.conftest import WORD, read


def _brute(w):
    """Every run, by trying each period at each place."""
    found = []
    ids = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.zeros(0)
    for q in range(1, len(w) // 4 + 1):
        edges = np.flatnonzero(np.diff(ids[:-q] == ids[q:], prepend=False, append=False))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            size, root = j - i + q, w[i : i + q]
            if size >= max(6, 4 * q) and all(q % d or root != root[:d] * (q // d) for d in range(1, q)):
                found.append((i, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def _words(rng):
    w = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        root = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        w += (root * rng.randint(2, 7))[: rng.randint(1, 50)] + [rng.choice("abxyz") for _ in range(rng.randint(0, 5))]
    return w


def test_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(400):
        w = _words(rng)
        assert [tuple(r) for r in sorted(runs.runs_of(np.array([ord(c) for c in w], np.uint64)).tolist(), key=lambda r: (r[0], r[2]))] == _brute(w)


def test_no_run_is_outside_of_the_suspects():
    rng = random.Random(5)
    texts = [_words(rng) for _ in range(300)]
    values = np.array([ord(c) for w in texts for c in w], np.uint64)
    found = runs._runs(values, np.concatenate([[0], np.cumsum([len(w) for w in texts])]))
    assert [found.get(k, []) for k in range(len(texts))] == [_brute(w) for w in texts]


def test_longest_common_extensions():
    rng = random.Random(6)
    s = [rng.randint(1, 2) for _ in range(200)] + [0]
    lce = runs.Extensions(s)
    i, j = np.array([(a, b) for a in range(200) for b in range(200) if a != b]).T
    for a, b, n in zip(i, j, lce(i, j)):
        k = 0
        while s[a + k] == s[b + k]:
            k += 1
        assert n == k
    assert sorted(range(201), key=lambda k: s[k:]) == sorted(range(201), key=lambda k: lce.rank[k])


def test_odd_texts(spark, odd_docs, no_docs):
    got = runs.collapsed(odd_docs).collect()
    assert len(got) == odd_docs.count() and got[0].asDict() == {"doc_id": 1, "n_words": 0, "runs": [], "text": None}
    assert {r.text for r in got if r.doc_id in (2, 3)} == {""}
    assert runs.collapsed(no_docs).count() == 0
    long = "start " + "la\tli \n lu " * 60_000 + "end"
    r = runs.collapsed(spark.createDataFrame([(1, long), (1, long), (None, "x x x x x x")], "doc_id long, text string")).collect()
    assert [(x.start, x.length, x.period) for x in r[0].runs] == [(1, 180_000, 3)] and r[0].text == "start la li lu end" and r[0] == r[1] and r[2].text == "x"


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    docs = read(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs)
    hit = 0
    for d in docs:
        w = WORD.findall(d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = _brute(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got[d.doc_id]
        hit += len(found)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(_kept(w, found).encode()).hexdigest()
    assert hit > 5


@pytest.mark.parametrize("text, best", [("a a a a a a b b b b b b b", (6, 7, 1)), ("a b a b a b a b x c d c d c d c d", (0, 8, 2)), ("a b c", None)])
def test_strongest(spark, text, best):
    r = runs.collapsed(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(runs.strongest(F.col("runs")).alias("s")).first().s
    assert (r and tuple(r)) == best
