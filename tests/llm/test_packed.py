"""Packed postings against brute force, and what line dedup and near dedup write."""

import collections
import os

import numpy as np

from framewright.llm import linededup, linked, neardup, store, suffixdedup, text


def test_packed_lists(spark, monkeypatch):
    """Every list of two nodes or more comes whole, a long one in blocks, whatever task sent its postings and how often."""
    rng = np.random.default_rng(5)
    for name, value in (("BLOCK", 64), ("DENSE", 512), ("LOOSE", 200), ("PACK", 16)):
        monkeypatch.setattr(linked, name, value)
    rule = linked.Rule(80, 2, 2, 9)
    values = rng.integers(-(1 << 62), 1 << 62, 700) * 2 + np.arange(700) % 2
    pairs = [(int(values[rng.integers(1, 700)]), int(x)) for x in rng.integers(0, 400, 900)] + [(int(values[0]), k) for k in range(3000)]
    pairs = [pairs[k] for k in rng.permutation(len(pairs) * 2) % len(pairs)]
    found = np.zeros(len(pairs), linked.record(rule))
    found["v"], found["node"] = np.array(pairs).T
    found["n"], found["s0"], found["s1"] = found["node"] + 1, found["node"] * 3, -found["node"]
    packs = [linked.packed(x) for x in np.array_split(found, 7)]
    assert all(len(d.as_py()) <= 16 * found.dtype.itemsize for p in packs for d in p["data"])
    rows = spark.createDataFrame([(int(a), bytearray(b)) for p in packs for a, b in zip(p["part"].to_pylist(), p["data"].to_pylist())], "part int, data binary")
    got = linked.packed_lists(rows, rule).collect()
    assert all((r.n, r.s0, r.s1) == (r.node + 1, r.node * 3, -r.node) for r in got)
    want = collections.defaultdict(set)
    for v, node in pairs:
        want[v].add(node)
    lists = collections.defaultdict(set)
    for r in got:
        lists[r.v].add(r.node)
    whole = lambda some: sorted((v % 2, sorted(x)) for v, x in some)
    brief = {v: x for v, x in lists.items() if v != pairs_long(values)}
    assert lists[pairs_long(values)] == want.pop(pairs_long(values)) == set(range(3000))
    named = {(v % 2, tuple(sorted(x))) for v, x in want.items() if len(x) > 1}  # equal lists have one name
    assert whole(brief.items()) == sorted((p, list(x)) for p, x in named)
    sizes = collections.Counter(r.block for r in got if r.v == pairs_long(values))
    assert sizes[0] == 64 and max(sizes.values()) == 64 and len(sizes) >= 47


def pairs_long(values):
    return int(values[0])


def test_op6_sends_texts_of_candidates_only(spark, monkeypatch):
    """Of lines that are like no other one, neither the bytes nor the bands are written."""
    lines = [" ".join(f"{chr(97 + (k * j) % 26)}{k * 7919 + j * 104729}" for j in range(1, 9)) for k in range(300)]
    lines += [lines[0] + " x", lines[5]]
    kept = {}
    monkeypatch.setattr(linededup, "written", lambda df, name: (t := store.written(df, name), kept.setdefault(name, t.collect() if name == "lines" else None))[0])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in linededup.without_repeated_lines(docs, counts=True).collect()}
    assert got == {k: int(k >= 300) for k in range(302)}
    with_text = {bytes(r["line"]).decode() for r in kept["lines"] if r["line"] is not None}
    assert {lines[0], lines[300]} <= with_text and len(with_text) < 10
    assert "bands" not in kept["lines"][0].asDict() and len(kept["lines"]) == 302


def test_near_dedup_keeps_no_sketches(spark, monkeypatch):
    """Sketches are deleted once the lists and the sketches of their members are written."""
    made = {}
    monkeypatch.setattr(neardup, "written", lambda df, name: made.setdefault(name, store.written(df, name)))
    words = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, words), (2, words + " x"), (3, "quite another text than those")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.classes(docs, 3, 80).collect()} == {1: 1, 2: 1, 3: 3}
    assert not any(os.path.exists(made[name].written_to.removeprefix("file://")) for name in ("sketches", "members"))


def test_bit_map(spark):
    """All hashes that were put in are found, and hardly any other."""
    rng = np.random.default_rng(3)
    put = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    found = store.bit_map(spark.createDataFrame([(int(x),) for x in put], "node long"))
    assert store.in_map(found, put).all() and store.in_map(found, rng.integers(-(1 << 63), (1 << 63) - 1, 100_000)).sum() < 100


def test_op2_scrambles_each_byte_twice_at_most(monkeypatch):
    """The pieces of a text are hashed from shared blocks, not each for itself."""
    raw = np.random.default_rng(2).integers(97, 123, 50_000).astype(np.uint8)
    done = []
    monkeypatch.setattr(text, "mix", lambda x, mix=text.mix: (done.append(len(x)), mix(x))[1])
    m, left, right, doc, twice = suffixdedup.stretches(raw, np.array([0, 20_000, 20_000, 50_000]))
    assert sum(done) < 2.5 * len(raw)
    assert left[0] == 0 and right[-1] == 50_000 and set(doc.tolist()) == {0, 2} and not twice.any()
    assert all(np.diff(left) > 0) and all((left[1:] == right[:-1] - 199) | (left[1:] == 20_000))


def test_piece_hash():
    """Equal pieces have equal hashes wherever they stand, other pieces other ones."""
    raw = np.random.default_rng(4).integers(0, 3, 4000).astype(np.uint8)
    for width in (3, 8, 9, 20, 32):
        found = text.piece_hash(raw, width)
        pieces = [raw[k : k + width].tobytes() for k in range(len(raw) - width + 1)]
        assert len(found) == len(pieces) and len(set(zip(found.tolist(), pieces))) == len(set(found.tolist())) == len(set(pieces))
