"""Links from inverted lists, and their components by distributed union-find.

A posting (v, node) says that a node holds the value v. Nodes of one list are candidates for a link if their
features (set size, signature) allow one; whole sets decide. In two rounds each list proposes a spanning forest only: the closest pairs by
signature that would join its components, so a list of m copies costs m - 1 pairs. Proposed pairs, true or not, tie nodes into clusters,
and two nodes that share a list and may be linked are always in one cluster. Last, the nodes that are left with a possible partner in another
component meet once more by cluster, with their whole sets; only links that join components leave the task.
So no such pair that shares a list is left out, and no square of a list or a group is written anywhere.

Lists are dealt to tasks in blocks of BLOCK nodes (later in pairs of blocks), clusters in pairs of blocks of about CLUSTER_NODES nodes and
CLUSTER_VALUES set values. The comparing inside these tasks is quadratic in the open members of one list or cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.store import discard, written

#: Nodes of a list that one task compares; lists of up to BRIEF nodes are compared many at once.
BLOCK, BRIEF = 8192, 16
CLUSTER_NODES, CLUSTER_VALUES = 4096, 1 << 22
_HELD = 1 << 18  # edges that a task joins before it sends them on
_FAR = 1 << 20
_AT_ONCE = 512  # lists up to this length are compared in one step
#: Packed postings: parts by value, records in one row, records that are sorted at once, and those of one part from which on whole blocks of long lists are sent.
PARTS, PACK, LOOSE, DENSE = 4096, 1024, 1 << 18, 1 << 22


@dataclass(frozen=True)
class Rule:
    """Which features allow a link: set sizes n within ``percent``, and at most ``limit`` differing values in the signature words s0, s1, ...

    A value takes ``bits`` (1 to 3) bits of a word.
    """

    percent: int
    words: int
    bits: int
    limit: int

    @property
    def names(self) -> list[str]:
        return ["n", *[f"s{k}" for k in range(self.words)]]

    def distance(self, x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
        """Differing values of pairs, _FAR where the features rule a link out; arrays broadcast."""
        total = 0
        for k in range(self.words):
            differ = x[f"s{k}"] ^ y[f"s{k}"]
            if self.bits == 2:
                differ = (differ | (differ >> 1)) & 0x5555555555555555
            elif self.bits == 3:
                differ = (differ | (differ >> 1) | (differ >> 2)) & 0x1249249249249249
            total = total + np.bitwise_count(differ.view(np.uint64)).astype(np.int32)
        near = np.minimum(x["n"], y["n"]) * 100 >= np.maximum(x["n"], y["n"]) * self.percent
        return np.where(near & (total <= self.limit), total, _FAR)


def most_differing(values: int, p: float, chance: float) -> int:
    """More of ``values`` values than this differ with a probability below ``chance`` if each differs with probability p (Chernoff's bound)."""
    far = lambda q: q * np.log(q / p) + ((1 - q) * np.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return next((c for c in range(int(values * p) + 1, values) if values * far((c + 1) / values) > -np.log(chance)), values)


def shared_lists(postings: DataFrame) -> DataFrame:
    """(v, node, block) of the values that at least two different nodes hold; block numbers each BLOCK nodes of a list.

    Each partition is sorted and read as a stream that remembers one row, so a list of any length
    needs no memory. Repeated postings count once. Lists of the same nodes often come by the dozen: those that a batch holds whole
    are named by their nodes (v stays odd or even), so that equal lists are found as one later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_v = last_node = None
        at_last = 0  # place of the last row's node in its list
        lead_out = False  # whether a list that goes on from the batch before has had its first row sent
        for batch in batches:
            if not batch.num_rows:
                continue
            v, node = (np.asarray(batch[c].to_numpy(zero_copy_only=False), np.int64) for c in ("v", "node"))
            new_v = np.ones(len(v), bool)
            new_v[1:] = v[1:] != v[:-1]
            new = new_v.copy()
            new[1:] |= node[1:] != node[:-1]
            carried = last_v is not None and v[0] == last_v
            if carried:
                new_v[0], new[0] = False, node[0] != last_node
            group = np.cumsum(new_v)  # 0: the list that goes on
            count = np.cumsum(new)
            first = np.flatnonzero(new_v)
            base = np.concatenate([[-1 - at_last if carried else 0], count[first]])
            place = count - base[group]
            out = np.flatnonzero(new & (place > 0))
            lead = out[place[out] == 1]  # second nodes: the first of the list goes out with them
            leads_node = np.where(group[lead] > 0, node[np.concatenate([[0], first])[group[lead]]], last_node if carried else 0)
            if carried and lead_out:
                leads_node = leads_node[group[lead] > 0]
            whole = np.zeros(len(first) + 1, bool)
            whole[1:-1] = True
            names = np.concatenate([[0], np.add.reduceat(np.where(new, tx.mix(node.view(np.uint64)), 0).astype(np.uint64), first).view(np.int64) if len(first) else []]).astype(np.int64)
            v = np.where(whole[group], (names[group] & ~np.int64(1)) | (v & 1), v)
            leads_v = v[lead] if not (carried and lead_out) else v[lead][group[lead] > 0]
            if len(out):
                rows = [np.concatenate([leads_v, v[out]]), np.concatenate([leads_node, node[out]]), np.concatenate([np.zeros(len(leads_v), np.int64), place[out] // BLOCK])]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.int64())], ["v", "node", "block"])
            lead_out = place[-1] > 0
            last_v, last_node, at_last = int(batch["v"][-1].as_py()), int(node[-1]), int(place[-1])

    dealt = postings.select("v", "node").repartition("v").sortWithinPartitions("v", "node")
    return dealt.mapInArrow(run, "v long, node long, block long")


def record(rule: Rule) -> np.dtype:
    """A posting with the features of its node."""
    return np.dtype([("v", "<i8"), ("node", "<i8"), ("n", "<i4"), *[(c, "<i8") for c in rule.names[1:]]])


def packed(records: np.ndarray) -> pa.RecordBatch:
    """Rows (part, data) of up to PACK records each; equal values v have the same part."""
    part = ((records["v"].view(np.uint64) >> tx.U64(32)) * tx.U64(PARTS) >> tx.U64(32)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    first = np.ones(len(part), bool)
    first[1:] = part[1:] != part[:-1]
    place = np.arange(len(part))
    first |= (place - np.maximum.accumulate(np.where(first, place, 0))) % PACK == 0
    start = np.flatnonzero(first)
    cut = (np.append(start, len(part)) * records.dtype.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(records).view(np.uint8))])
    return pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int32)), data], ["part", "data"])


def packed_lists(packs: DataFrame, rule: Rule, propose: bool = False) -> DataFrame:
    """(v, node, block, features) as of ``shared_lists``, from rows (part, data) of ``packed``.

    With ``propose``, whole lists of up to BRIEF nodes propose their pairs here and are not sent on: rows (node, b) are pairs, rows (v, node) without a block name
    nodes that have further allowed partners, as of ``_proposed``.

    Spark sorts the rows by part; a task holds the postings of a few parts. Beyond DENSE in one part it sends whole blocks of BLOCK nodes on, so
    of a long list it holds one block; a node may then stand in more than one block of its list. Whole lists are named by their nodes.
    """
    kind = record(rule)

    def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct postings by v and node, where each list starts, and its length."""
        rows = rows[np.lexsort((rows["node"], rows["v"]))]
        v, node = np.ascontiguousarray(rows["v"]), np.ascontiguousarray(rows["node"])
        new_v = np.ones(len(v), bool)
        new_v[1:] = v[1:] != v[:-1]
        new = new_v.copy()
        new[1:] |= node[1:] != node[:-1]
        rows, start = rows[new], np.flatnonzero(new_v[new])
        return rows, start, np.diff(np.append(start, len(rows)))

    fields = ["v", "node", "block", *rule.names, *(["b"] if propose else [])]

    def batch(**columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns["node"])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[c])) if c in columns else pa.nulls(n, pa.int64()) for c in fields], fields)

    def made(rows: np.ndarray, v: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        return batch(v=v, node=rows["node"], block=block, **{c: rows[c].astype(np.int64) for c in rule.names})

    def proposed(rows: np.ndarray, name: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of brief lists, and the nodes that stay open."""
        few = {c: rows[c].astype(np.int64) for c in ("node", *rule.names)}
        few["root"] = few["node"]
        group = np.repeat(np.arange(len(size)), size)
        i, j, left = _brief_forest(few, group, np.diff(group, prepend=-1) > 0, rule)
        a, b = few["node"][i], few["node"][j]
        yield batch(node=np.minimum(a, b), b=np.maximum(a, b))
        is_open = np.isin(group, left)
        yield batch(v=np.repeat(name, size)[is_open], node=few["node"][is_open])

    def blocks(rows: np.ndarray, sent: dict[int, int]) -> tuple[pa.RecordBatch, np.ndarray]:
        """Whole blocks of long lists, counted in ``sent``, and the other rows."""
        rows, start, size = in_order(rows)
        base = np.array([sent.get(x, 0) for x in rows["v"][start].tolist()], np.int64)
        place = np.arange(len(rows)) - np.repeat(start, size)
        out = place < np.repeat(size // BLOCK * BLOCK, size)
        long = size >= BLOCK
        sent |= zip(rows["v"][start[long]].tolist(), (base + size // BLOCK)[long].tolist())
        return made(rows[out], rows["v"][out], (np.repeat(base, size) + place // BLOCK)[out]), rows[~out]

    def lists(rows: np.ndarray, sent: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """The lists of rows that hold all postings of their parts but for the blocks sent."""
        v = np.ascontiguousarray(rows["v"])
        order = np.argsort(v)
        v = v[order]
        again = v[1:] == v[:-1]
        some = np.zeros(len(v), bool)
        some[1:] = again
        some[:-1] |= again
        if sent:
            some |= np.isin(v, np.fromiter(sent, np.int64))
        rows, start, size = in_order(rows[order[some]])
        base = np.array([sent.get(x, 0) for x in rows["v"][start].tolist()], np.int64) if sent else np.zeros(len(start), np.int64)
        name = rows["v"][start]
        if len(rows):
            sums = np.add.reduceat(tx.mix(np.ascontiguousarray(rows["node"]).view(np.uint64)), start).view(np.int64)
            name = np.where(base > 0, name, (sums & ~np.int64(1)) | (name & 1))
        place = np.arange(len(rows)) - np.repeat(start, size)
        chosen = (size > 1) | (base > 0)
        if propose:
            brief = (size > 1) & (size <= BRIEF) & (base == 0)
            yield from proposed(rows[np.repeat(brief, size)], name[brief], size[brief])
            chosen &= ~brief
        out = np.repeat(chosen, size)
        yield made(rows[out], np.repeat(name, size)[out], (np.repeat(base, size) + place // BLOCK)[out])

    joined = lambda held: np.frombuffer(b"".join(held), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        count, now, most = 0, None, DENSE
        sent: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, data = batch["part"].to_numpy(), batch["data"]
            cut = np.asarray(pa.Array.from_buffers(pa.int32(), len(data) + 1, [None, data.buffers()[1]], offset=data.offset))
            start = np.flatnonzero(np.diff(part, prepend=-1))
            for s, e in zip(start, [*start[1:], len(part)]):
                if part[s] != now and count >= LOOSE:
                    yield from lists(joined(held), sent)
                    held, count, most, sent = [], 0, DENSE, {}
                now = part[s]
                held.append(bytes(data.buffers()[2][int(cut[s]) : int(cut[e])]))
                count += len(held[-1]) // kind.itemsize
                if count > most:
                    found, rest = blocks(joined(held), sent)
                    yield found
                    held, count, most = [rest.tobytes()], len(rest), max(DENSE, 2 * len(rest))
        if held:
            yield from lists(joined(held), sent)

    return packs.repartition("part").sortWithinPartitions("part").mapInArrow(run, ", ".join(f"{c} long" for c in fields))


def _joined(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of which each task has joined its own to stars around the smallest node."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        pairs = np.array([(x, r) for x in parent if (r := root(x)) != x], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                while parent.setdefault(a, a) != a:
                    parent[a] = a = parent[parent[a]]
                while parent.setdefault(b, b) != b:
                    parent[b] = b = parent[parent[b]]
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 4 * _HELD:
                yield stars(parent)
                parent = {}
        yield stars(parent)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root is the smallest node of its component.

    Tasks join _HELD edges each first. Then large-star and small-star steps alternate; each round is written, so a lost executor costs one round.
    """

    def down(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()

    edges = edges.coalesce(max(1, -(-edges.count() // _HELD)))
    edges, before = written(down(_joined(edges), "a", "b"), "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        # Done if a round changed nothing, or if every edge starts at another node and ends at one where none starts.
        if now == before or not now[0]:
            break
        if now[0] == now[2] and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = down(both.filter("b > a").join(least, "a"), "b", "m")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, edges = edges, written(down(small, "a", "b"), "edges")
        discard(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows, cut so that no group of equal keys is divided."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: np.asarray(batch[c].to_numpy(zero_copy_only=False)) for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], x]) for c, x in now.items()}
        last = np.logical_and.reduce([now[k] == now[k][-1] for k in keys])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield {c: x[:cut] for c, x in now.items()}
        held = {c: x[cut:] for c, x in now.items()}
    if held is not None:
        yield held


def _brief_pairs(rows: dict, group: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Allowed pairs (i, j) of rows in one group and different components, and their distances; groups are brief."""
    at, to, far = [], [], []
    for lag in range(1, BRIEF):
        i = np.flatnonzero(group[lag:] == group[: len(group) - lag]) if len(group) > lag else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + lag
        apart = rows["root"][i] != rows["root"][j]
        i, j = i[apart], j[apart]
        d = rule.distance({c: rows[c][i] for c in rule.names}, {c: rows[c][j] for c in rule.names})
        near = d < _FAR
        at.append(i[near])
        to.append(j[near])
        far.append(d[near])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (at, to, far))


def _brief_forest(rows: dict, group: np.ndarray, first: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that join near rows of brief groups, and the groups with allowed pairs that are left out."""
    i, j, d = _brief_pairs(rows, group, rule)
    least = np.full(len(group), _FAR)
    np.minimum.at(least, i, d)
    np.minimum.at(least, j, d)
    chosen = (d == least[i]) | (d == least[j]) | first[i]
    return i[chosen], j[chosen], np.unique(group[i[~chosen]])


def _forest(rows: dict, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's algorithm over the rows of one list, whose components count as joined: the chosen pairs, and for each row how many pairs are allowed."""
    n = len(rows["node"])
    best, via, todo = np.full(n, _FAR, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    at, to, allowed = [], [], np.zeros(n, np.int64)

    def distances(k: np.ndarray | int) -> np.ndarray:
        d = rule.distance({c: rows[c][k, None] if isinstance(k, np.ndarray) else rows[c][k] for c in rule.names}, {c: rows[c] for c in rule.names})
        d[rows["root"] == (rows["root"][k, None] if isinstance(k, np.ndarray) else rows["root"][k])] = -1
        return d

    every = distances(np.arange(n)) if n <= _AT_ONCE else None
    k = 0
    for _ in range(n):
        todo[k] = False
        d = every[k] if every is not None else distances(k)
        allowed[k] = np.count_nonzero((d >= 0) & (d < _FAR))
        closer = d < best
        best[closer], via[closer] = d[closer], k
        open_rows = np.flatnonzero(todo)
        if not len(open_rows):
            break
        k = int(open_rows[best[open_rows].argmin()])
        if 0 <= best[k] < _FAR:
            at.append(via[k])
            to.append(k)
    return np.array(at, np.int64), np.array(to, np.int64), allowed


def _proposed(rows: DataFrame, rule: Rule, last: bool) -> DataFrame:
    """Pairs (a, b), a < b, of rows (v, i, j, node, root, features) that stand together under v, i, j; v is null there. Rows (v, a) name nodes that have
    further allowed partners, or stand in a list of several blocks. With ``last``, brief lists propose all pairs, and lists of several blocks come in pairs of blocks."""

    def batch(v: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        if b is not None:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.RecordBatch.from_arrays([none if v is None else pa.array(v), pa.array(a), none if b is None else pa.array(b)], ["v", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _whole_groups(batches, ("v", "i", "j")):
            once = np.ones(len(found["v"]), bool)
            once[1:] = np.logical_or.reduce([found[k][1:] != found[k][:-1] for k in ("v", "i", "j", "node")])
            found = {c: x[once] for c, x in found.items()}
            new = np.ones(len(found["v"]), bool)
            new[1:] = np.logical_or.reduce([found[k][1:] != found[k][:-1] for k in ("v", "i", "j")])
            start = np.flatnonzero(new)
            size = np.diff(np.concatenate([start, [len(new)]]))
            brief = np.repeat(size <= BRIEF, size)
            few = {c: x[brief] for c, x in found.items()}
            group = np.cumsum(new)[brief]
            if last:
                i, j, _ = _brief_pairs(few, group, rule)
            else:
                i, j, left = _brief_forest(few, group, new[brief], rule)
                is_open = np.isin(group, left) | (few["i"] > 0)
                yield batch(few["v"][is_open], few["node"][is_open], None)
            yield batch(None, few["node"][i], few["node"][j])
            for s, n in zip(start, size):
                if brief[s]:
                    continue
                own = {c: x[s : s + n] for c, x in found.items()}
                i, j, allowed = _forest(own, rule)
                yield batch(None, own["node"][i], own["node"][j])
                is_open = (allowed > 0) & (allowed.sum() > 2 * len(i))
                if not last and (n == BLOCK or own["i"][0] > 0):  # rows of other blocks may be near as well
                    is_open[:] = True
                yield batch(own["v"][is_open], own["node"][is_open], None)

    names = ["v", "i", "j", "node", "root", *rule.names]
    dealt = rows.select(*names).repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "node")
    return dealt.mapInArrow(run, "v long, a long, b long")


def _last_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that join components, from rows (cluster, i, j, block, node, root, features, values): all allowed pairs between blocks i and j are compared by whole sets."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        own = {c: table[c].to_numpy() for c in ("node", "root", *rule.names)}
        values = table["values"].combine_chunks()
        flat, cut = values.flatten().to_numpy().view(np.uint64), np.asarray(values.offsets).astype(np.int64)
        cut = cut - cut[0]
        parent = {int(r): int(r) for r in own["root"]}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def sets(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = cut[at + 1] - cut[at]
            upto = np.concatenate([[0], np.cumsum(size)])
            return flat[np.arange(upto[-1]) + np.repeat(cut[at] - upto[:-1], size)], upto

        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = []
        for lo in range(0, len(left), 64):
            x, y = left[lo : lo + 64], right
            root = np.array([top(int(r)) for r in own["root"]], np.int64)
            keep = rule.distance({c: own[c][x, None] for c in rule.names}, {c: own[c][None, y] for c in rule.names}) < _FAR
            keep &= root[x, None] != root[None, y]
            if i == j:
                keep &= own["node"][x, None] < own["node"][None, y]
            r, c = np.nonzero(keep)
            for at in range(0, len(r), 512):
                p, q = x[r[at : at + 512]], y[c[at : at + 512]]
                (vp, sp), (vq, sq) = sets(p), sets(q)
                both = tx.overlaps(vp, sp, vq, sq)
                near = 100 * both >= rule.percent * (np.diff(sp) + np.diff(sq) - both)
                for a, b in zip(p[near].tolist(), q[near].tolist()):
                    ra, rb = top(int(own["root"][a])), top(int(own["root"][b]))
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        links.append((int(own["node"][a]), int(own["node"][b])))
        made = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": made.min(1) if len(made) else made[:, 0], "b": made.max(1) if len(made) else made[:, 1]})

    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def link(lists: DataFrame, features: DataFrame | None, rule: Rule, texts: Callable, verify: Callable, sets: Callable, sharper: tuple[Rule, Callable] | None = None) -> DataFrame:
    """(node, root) from lists (v, node, block).

    ``features`` has one row (node, features of ``rule``) per node; or one per (node, kind), where lists of even v use kind 0 and
    others kind 1; or it is None if ``lists`` has the features and what brief lists propose (``packed_lists``), and ``sharper`` is given. ``lists`` is a written
    table, discarded here.

    ``texts(nodes)`` writes what is needed of the nodes that may get links, once; ``verify(pairs, texts)`` writes the true links of
    pairs (a, b); ``sets(nodes, texts)`` writes (node, values) of a table of nodes: its whole set, ascending. ``sharper`` has a rule with longer
    signatures for the lists that stay open, and writes the features of it: ``make(nodes, texts)``, one row per node.
    """

    def propose(rows: DataFrame, last: bool, features: DataFrame | None, rule: Rule) -> tuple[DataFrame, DataFrame]:
        if features is None:
            met = rows.filter("block is not null")
        elif "kind" in features.columns:
            met = rows.withColumn("kind", F.pmod("v", F.lit(2))).join(features, ["node", "kind"])
        else:
            met = rows.join(features, "node")
        found = _proposed(met, rule, last)
        if features is None:
            found = found.unionByName(rows.filter("block is null").select("v", F.col("node").alias("a"), "b").distinct())
        found = written(found, "proposed")
        return found, found.filter("b is not null").select("a", "b").distinct()

    def placed(nodes: DataFrame, key: str) -> DataFrame:
        """Rows (key, node) of those keys whose nodes are in more than one component, with root and counts."""
        rows = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sums = [F.sum("n").alias("values")] if "n" in nodes.columns else []
        some = rows.groupBy(key).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members"), *sums).filter("r0 <> r1")
        return rows.join(some.drop("r0", "r1"), key)

    def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
        """Every row once for each pair of blocks (i, j) that its block is in."""
        rows = rows.withColumn("blocks", F.ceil(blocks).cast("long")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        return rows.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    own_block = F.col("block")
    first, pairs = propose(lists.withColumn("root", F.col("node")).withColumn("i", own_block).withColumn("j", own_block), False, features, rule)
    tried = written(pairs, "tried")
    involved = first.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    known = texts(involved)
    links = verify(tried, known)
    roots = written(components(links), "roots")
    discard(links, lists)
    left = first.filter("b is null").select("v", F.col("a").alias("node"))
    if left.isEmpty():
        discard(first, tried, known)
        return roots

    rows = written(placed(left, "v"), "open")
    if sharper:
        rule, make = sharper
        features = make(rows.select("node").distinct(), known)
    second, pairs = propose(in_blocks(rows, F.col("members") / BLOCK), True, features, rule)
    new = written(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
    as_edges = lambda: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not new.isEmpty():
        links = verify(new, known)
        roots = written(components(links.unionByName(as_edges())), "roots")
        discard(links)
    left = second.filter("b is null").select(F.col("a").alias("node")).distinct()
    if not left.isEmpty():
        # What round two proposed, and its components, tie each node that is left to its possible partners.
        ties = pairs.unionByName(rows.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
        ties = written(ties, "ties")
        clusters = written(components(ties), "clusters")
        discard(rows, ties)
        met = left.join(clusters.select("node", F.col("root").alias("cluster")), "node").join(features.select("node", "n").distinct(), "node")
        rows = written(placed(met, "cluster").drop("n"), "apart")
        rows_sets = sets(rows.select("node"), known)
        blocks = F.greatest(F.col("members") / CLUSTER_NODES, F.col("values") / CLUSTER_VALUES)
        whole = in_blocks(rows, blocks).drop("values").join(rows_sets, "node").join(features, "node")
        links = written(_last_links(whole, rule), "links")
        roots = written(components(links.unionByName(as_edges())), "roots")
        discard(links, rows, rows_sets, clusters)
    discard(first, second, tried, new, known, *([features] if sharper else []))
    return roots
