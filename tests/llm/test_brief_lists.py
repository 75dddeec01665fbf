"""Brief lists propose their pairs where they are found; signatures of three bits a value."""

import numpy as np

from framewright.llm import linededup, linked


def test_brief_lists_propose_in_place(spark):
    """Nodes of a brief list that may be linked are tied by its pairs, or stand open; only longer lists are sent on."""
    rng = np.random.default_rng(8)
    rule = linked.Rule(80, 2, 2, 12)
    want = {int(v): rng.choice(500, n, replace=False) for v, n in zip(rng.integers(-(1 << 62), 1 << 62, 300), [*rng.integers(1, 9, 298), 16, 40])}
    found = np.zeros(sum(map(len, want.values())), linked.record(rule))
    found["v"], found["node"] = np.repeat(list(want), [len(x) for x in want.values()]), np.concatenate(list(want.values()))
    kind = found["node"] % 5  # nodes of one kind are near each other
    found["n"], found["s0"], found["s1"] = 100, np.array([0, 0x5555555555, -1, 0x5555 << 40, 0x55555555555])[kind], kind * 0x1111
    rows = [(int(a), bytearray(b)) for x in np.array_split(rng.permutation(found), 5) for p in [linked.packed(x)] for a, b in zip(p["part"].to_pylist(), p["data"].to_pylist())]
    got = linked.packed_lists(spark.createDataFrame(rows, "part int, data binary"), rule, propose=True).collect()
    features = {int(r["node"]): {c: np.array([r[c]], np.int64) for c in rule.names} for r in found}
    allowed = lambda a, b: rule.distance(features[a], features[b])[0] <= rule.limit
    assert {r.node for r in got if r.block is not None} == set(list(want.values())[-1].tolist())
    pairs = {(r.node, r.b) for r in got if r.b is not None}
    assert all(a < b and allowed(a, b) for a, b in pairs)
    is_open = {r.node for r in got if r.block is None and r.b is None}
    for nodes in list(want.values())[:-1]:
        for a in map(int, nodes):
            for b in map(int, nodes):
                assert a >= b or not allowed(a, b) or (a, b) in pairs or {a, b} <= is_open


def test_three_bits_of_each_value():
    """The rule counts differing values, whichever of their last three bits differ."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, (50, linededup._K), dtype=np.uint64)
    y = np.where(rng.random(x.shape) < 0.2, rng.integers(0, 1 << 63, x.shape, dtype=np.uint64), x)
    side = lambda s: {"n": np.full(len(s), 9), **{f"s{k}": c.view(np.int64) for k, c in enumerate(np.ascontiguousarray(linededup._packed(s, linededup.RULE).T))}}
    differ = ((x ^ y) & np.uint64(7) > 0).sum(1)
    assert linededup.RULE.distance(side(x), side(y)).tolist() == np.where(differ <= linededup.RULE.limit, differ, linked._FAR).tolist() and len(set(differ.tolist())) > 5
