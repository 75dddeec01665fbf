"""Shard counts of the mix are multinomial draws; the permutation of blocks is one and no rotation."""

import collections

from pyspark.sql import functions as F

from framewright.llm import mixing


def test_counts_per_shard(spark):
    """Full shards, every slot of a source once, and counts that vary as multinomial ones do."""
    sources = spark.createDataFrame([(0, 90_000, 60_000), (1, 60_000, 60_000), (2, 10, 20), (3, 0, 0), (4, 500_000, 300_001)], "sid long, blocks long, slots long")
    rows = mixing._slots(sources, 7).select("shard", "sid", "k").toPandas()
    slots = {r.sid: r.slots for r in sources.collect()}
    for sid, mine in rows.groupby("sid")["k"]:
        assert sorted(mine) == list(range(slots[sid]))
    assert set(rows["sid"]) == {0, 1, 2, 4}
    total, n = sum(slots.values()), mixing.SLOTS_PER_SHARD
    sizes = rows.groupby("shard").size()
    assert len(sizes) == -(-total // n) and all(sizes[:-1] == n) and sizes.iloc[-1] == total - n * (len(sizes) - 1)
    counts = rows.groupby(["shard", "sid"]).size().unstack(fill_value=0)[:-1]
    for sid in (0, 1, 4):
        p = slots[sid] / total
        assert abs(counts[sid].mean() - n * p) < 0.01 * n * p
        assert 0.75 < counts[sid].var() / (n * p * (1 - p)) < 1.25, sid  # 409 shards: standard deviation 0.07
    p, q = slots[0] / total, slots[4] / total
    assert 0.6 < counts[[0, 4]].cov().loc[0, 4] / (-n * p * q) < 1.4
    early, late = counts[: len(counts) // 2], counts[len(counts) // 2 :]
    assert all(abs(early[s].mean() - late[s].mean()) < 4 * counts[s].std() * (4 / len(counts)) ** 0.5 for s in (0, 1, 4))


def test_slots_without_sources(spark):
    none = spark.createDataFrame([], "sid long, blocks long, slots long")
    assert mixing._slots(none, 7).count() == 0


def test_permutation_of_any_size(spark):
    """All values once for every size; steps between neighbours differ, unlike those of a rotation or reflection."""
    sizes = [*range(1, 40), 199, 1021, 4096, 20_001]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    found = collections.defaultdict(dict)
    for r in mixing._permuted(rows.withColumn("sid", F.lit(3)), "b", "k", "n", 7).collect():
        found[r.n][r.k] = r.b
    for n in sizes:
        values = [found[n][k] for k in range(n)]
        assert sorted(values) == list(range(n))
        steps = {(b - a) % n for a, b in zip(values, values[1:])}
        assert n < 12 or len(steps) > n / 3, n
        assert n < 199 or sum(abs(v - k) < n / 10 for k, v in enumerate(values)) < 0.3 * n
