"""External induced sorting of one shard, with common-prefix values.

The suffixes of many strings are put in order up to ``width`` bytes: suffixes that begin an S-type run
(their order comes from names of the substrings between them, refined by doubling) seed the L-type
suffixes, those the S-type ones. Every step takes the suffixes of one leading byte in rank order and
hands (predecessor, common prefix) to the queue of the predecessor's byte; a queue is first in, first out, for rank
order within a byte is the order of arrival. Queues beyond a memory limit go on in files. A common
prefix is one more than the least one since the last hand-over to that queue, so no text is compared but where
L- and S-type suffixes of one byte meet.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

_SYMBOLS = 257  # 0 ends a string; byte b is b + 1
_ITEM = np.dtype([("at", np.int64), ("lcp", np.int16)])
_BLOCK = 1 << 20


class Queue:
    """First in, first out; appended parts beyond ``limit`` items go to a file. Can also be read backwards."""

    def __init__(self, folder: str, name: str, limit: int):
        self.path, self.limit = os.path.join(folder, name), limit
        self.parts: list[np.ndarray] = []
        self.held = self.on_disk = self.read_from = 0

    def push(self, items: np.ndarray) -> None:
        self.parts.append(items)
        self.held += len(items)
        if self.held > self.limit:
            with open(self.path, "ab") as f:
                for part in self.parts:
                    part.tofile(f)
            self.on_disk += self.held
            self.parts, self.held = [], 0

    def pop(self) -> np.ndarray | None:
        if self.read_from < self.on_disk:
            n = min(_BLOCK, self.on_disk - self.read_from)
            items = np.fromfile(self.path, _ITEM, n, offset=self.read_from * _ITEM.itemsize)
            self.read_from += n
            return items
        if not self.parts:
            return None
        items = np.concatenate(self.parts)
        self.parts, self.held = [], 0
        return items

    def backwards(self):
        """Blocks from the last to the first, each in order of arrival."""
        if self.parts:
            yield np.concatenate(self.parts)
        end = self.on_disk
        while end:
            n = min(_BLOCK, end)
            end -= n
            yield np.fromfile(self.path, _ITEM, n, offset=end * _ITEM.itemsize)


def _items(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), _ITEM)
    out["at"], out["lcp"] = at, lcp
    return out


def _s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last counts as such."""
    n = len(t)
    decided = np.full(n, n - 1, np.int64)
    differs = np.flatnonzero(t[:-1] != t[1:])
    decided[differs] = differs
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    rises = np.ones(n, bool)
    rises[:-1] = t[:-1] < t[1:]
    return rises[decided]


def _fours(t: np.ndarray) -> np.ndarray:
    """Four symbols from each place on, in one integer, the first one lowest."""
    w = t.astype(np.uint64)
    out = w[:-3].copy()
    for k in range(1, 4):
        out |= w[k : len(w) - 3 + k] << np.uint64(16 * k)
    return out


def _common(fours: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to ``cap``; the text is padded by ``cap`` symbols."""
    out = np.full(len(a), cap, np.int16)
    live = np.arange(len(a))
    for off in range(0, cap, 4):
        differ = fours[a + off] ^ fours[b + off]
        stop = differ != 0
        if stop.any():
            low = differ[stop] & (~differ[stop] + np.uint64(1))  # the lowest bit that differs
            out[live[stop]] = np.minimum(off + np.log2(low.astype(float)).astype(np.int16) // 16, cap)
            go = ~stop
            live, a, b = live[go], a[go], b[go]
            if not len(live):
                break
    return out


def _refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by key; a rank is the number of smaller items. Returns those still tied."""
    if len(key) and key.max() < 1 << 32:  # ranks as keys: one sort of both
        order = np.argsort((rank[live].astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64), kind="stable")
    else:
        order = np.lexsort((key, rank[live]))
    live, key = live[order], key[order]
    old = rank[live]
    n = len(live)
    fresh = np.ones(n, bool)
    fresh[1:] = old[1:] != old[:-1]
    new = fresh.copy()
    new[1:] |= key[1:] != key[:-1]
    here = np.arange(n)
    group_start = np.maximum.accumulate(np.where(fresh, here, 0))
    part_start = np.maximum.accumulate(np.where(new, here, 0))
    rank[live] = old + part_start - group_start
    last = np.append(new[1:], True)
    return live[~(new & last)]


def _sorted_stars(t: np.ndarray, is_s: np.ndarray, stars: np.ndarray, n: int, width: int) -> np.ndarray:
    """Order of the S* suffixes up to ``width`` symbols or the end of their string."""
    m = len(stars)
    size = np.append(stars[1:], n) - stars + 1
    ends = t[stars] == 0
    rank = np.where(ends, 0, ends.sum()).astype(np.int64)
    live = np.flatnonzero(~ends)
    code = np.zeros(n + width + 16, np.uint64)
    code[:n] = t[:n].astype(np.uint64) * np.uint64(2) + is_s
    for off in range(0, width, 6):
        key = np.zeros(len(live), np.uint64)
        for k in range(off, off + 6):
            key = (key << np.uint64(10)) | np.where(k < size[live], code[np.minimum(stars[live] + k, n)], np.uint64(0))
        tied = _refine(rank, live, key)
        live = tied[size[tied] > off + 6]
        if not len(live):
            break
    del code
    # All groups that are still tied, names of whole substrings now equal.
    order = np.argsort(rank, kind="stable")
    same = np.zeros(m, bool)
    same[1:] = rank[order][1:] == rank[order][:-1]
    same[:-1] |= same[1:]
    live = order[same]
    live = live[~ends[live]]
    stop = np.flatnonzero(ends)
    stop = stop[np.minimum(np.searchsorted(stop, np.arange(m)), len(stop) - 1)]
    step = 1
    while len(live) and step < width:
        live = _refine(rank, live, rank[np.minimum(live + step, stop[live])])
        step *= 2
    return stars[np.argsort(rank, kind="stable")]


class _Pass:
    """Hands predecessors to their queues and keeps the least common prefix since the last hand-over."""

    def __init__(self, t: np.ndarray, queues: list[Queue], cap: int):
        self.t, self.queues, self.cap = t, queues, cap
        self.least = np.full(_SYMBOLS, -1, np.int16)

    def hand_over(self, at: np.ndarray, lcp: np.ndarray, wanted) -> None:
        before = at - 1
        symbol = self.t[np.maximum(before, 0)]
        ok = (before >= 0) & wanted(symbol, self.t[at])
        target = np.where(ok, symbol, _SYMBOLS).astype(np.int64)
        order = np.argsort(target, kind="stable")
        bounds = np.searchsorted(target[order], np.arange(_SYMBOLS + 1))
        held = self.least.copy()
        np.minimum(self.least, lcp.min(), out=self.least)
        for c in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[c] : bounds[c + 1]]
            mins = np.minimum.reduceat(lcp, np.concatenate([[0], own + 1])[: len(own) + (own[-1] + 1 < len(lcp))])
            first = min(int(held[c]), int(mins[0]))
            value = mins[: len(own)].copy()
            value[0] = first
            self.least[c] = mins[len(own)] if len(mins) > len(own) else self.cap
            self.queues[c].push(_items(before[own], np.minimum(value + 1, self.cap)))


def repeated_spans(strings: list[bytes], width: int, held_items: int = 1 << 24, folder: str | None = None) -> list[tuple[int, int, int]]:
    """(string, first byte, end byte) of the maximal spans made of ``width``-byte strings that start
    at two or more places in ``strings``."""
    strings_size = np.array([len(s) for s in strings], np.int64)
    begins = np.concatenate([[0], np.cumsum(strings_size + 1)])
    n = int(begins[-1])
    if not n or strings_size.max() < width:
        return []
    t = np.zeros(n + width + 8, np.uint16)
    joined = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8)
    t[:n] = joined.astype(np.uint16) + 1
    t[begins[1:] - 1] = 0
    is_s = _s_types(t[:n])
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    stars = _sorted_stars(t, is_s, stars, n, width)
    fours = _fours(t)
    star_lcp = np.zeros(len(stars), np.int16)
    star_lcp[1:] = _common(fours, stars[:-1], stars[1:], width)
    star_bounds = np.searchsorted(t[stars], np.arange(_SYMBOLS + 1))
    own_folder = tempfile.mkdtemp(dir=folder)
    repeated = np.zeros(n, bool)
    limit = max(1, held_items // _SYMBOLS)
    try:
        queues = [[Queue(own_folder, f"{kind}{c}", limit) for c in range(_SYMBOLS)] for kind in "lks"]
        large, kept, small = queues

        def note(at: np.ndarray, lcp: np.ndarray, last: int) -> None:
            hit = np.flatnonzero(lcp >= width)
            repeated[at[hit]] = True
            repeated[at[hit[hit > 0] - 1]] = True
            if last >= 0 and len(hit) and hit[0] == 0:
                repeated[last] = True

        scan = _Pass(t, large, width)
        for c in range(_SYMBOLS):
            last = -1
            while (items := large[c].pop()) is not None:
                kept[c].push(items)
                note(items["at"], items["lcp"], last)
                last = int(items["at"][-1])
                scan.hand_over(items["at"], items["lcp"], lambda p, x: p >= x)
            seeds = slice(star_bounds[c], star_bounds[c + 1])
            if seeds.stop > seeds.start:
                lcp = star_lcp[seeds].copy()
                lcp[0] = _common(fours, np.array([last]), stars[seeds][:1], width)[0] if last >= 0 else 0
                scan.hand_over(stars[seeds], lcp, lambda p, x: p >= x)

        scan = _Pass(t, small, width)
        for c in range(_SYMBOLS - 1, -1, -1):
            last = -1
            while (items := small[c].pop()) is not None:
                note(items["at"], items["lcp"], last)
                last = int(items["at"][-1])
                scan.hand_over(items["at"], items["lcp"], lambda p, x: p <= x)
            carry = -1  # common prefix of the block's last item with the one above it
            for items in kept[c].backwards():
                at, lcp = items["at"][::-1], np.empty(len(items), np.int16)
                lcp[1:] = items["lcp"][::-1][:-1]
                if carry < 0:
                    lcp[0] = _common(fours, at[:1].copy(), np.array([last]), width)[0] if last >= 0 else 0
                    if lcp[0] >= width:
                        repeated[[at[0], last]] = True
                else:
                    lcp[0] = carry
                carry = int(items["lcp"][0])
                scan.hand_over(at, lcp, lambda p, x: p < x)
    finally:
        shutil.rmtree(own_folder, ignore_errors=True)

    room = np.repeat(begins[1:] - 1, strings_size + 1) - np.arange(n)
    starts = np.flatnonzero(repeated & (room >= width))
    if not len(starts):
        return []
    owner = np.searchsorted(begins, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > starts[:-1] + width) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(starts)) - 1
    base = begins[owner[first]]
    return list(zip(owner[first].tolist(), (starts[first] - base).tolist(), (starts[final] + width - base).tolist()))
