"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than space and U+0009..U+000D, so UTF-8 text can be
scanned as bytes. Every function takes the raw UTF-8 buffer of many documents and their
offsets; nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end a token where punctuation is not wanted: all ASCII but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Values that are worked on at once, to stay in the processor's cache.
_NEAR = 1 << 16
#: Blocks of 8 bytes of a span that are read for all spans at once, and the masks of its last one.
_BLOCKS = 4
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
# Once an array of this size has been freed, glibc keeps the memory of smaller ones for the next; else each array of a slice comes as new pages from the kernel.
np.empty(31 << 20, np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    z = y >> U64(27)
    y ^= z
    y *= U64(0x94D049BB133111EB)
    return y ^ (y >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: first row, end row, bytes, offsets."""
    raw, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return _LOWER.take(raw)


def inked(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return ~_SPACE[raw]


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each document (n + 1).

    ``space`` flags the bytes between words.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ink = ~space[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~ink[:-1]
    inner = offsets[offsets < len(raw)]
    first[inner] = True
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~ink[1:]
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(ink & first)
    ends = np.flatnonzero(ink & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte, document and number in it of every line; lines end at U+000A."""
    breaks = np.flatnonzero(raw == 10)
    left = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((left, doc))
    left, doc = left[order], doc[order]
    last = np.ones(len(left), bool)
    last[:-1] = doc[1:] != doc[:-1]
    right = offsets[doc + 1].copy()
    right[:-1][~last[:-1]] = left[1:][~last[:-1]] - 1
    first = np.searchsorted(doc, doc)
    return left, right, doc, np.arange(len(left)) - first


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the offsets (any ascending byte positions between them) in code points."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    inner = np.flatnonzero(raw.view(np.int8) < -64)  # bytes within a code point
    return points, offsets - np.searchsorted(inner, offsets)


def _place(index: np.ndarray, seed: int) -> np.ndarray:
    """A fixed scrambled number for each place in a run, another one for each seed."""
    return mix((index.astype(np.uint64) + U64(1)) * U64(_MUL) ^ U64(mix_int(seed)))


def mix_int(seed: int) -> int:
    """``mix`` of a plain number."""
    return int(mix(np.array([seed * 2 + 1], np.uint64))[0])


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal bytes anywhere; another seed gives an independent hash.

    Every block of 8 bytes is scrambled together with its place in the span before blocks are summed, so no
    regular arrangement of the text makes the sum cancel out, as it does in a polynomial modulo 2^64.
    """
    size = (ends - starts).astype(np.int64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    at = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    starts = np.asarray(starts, np.int64)
    total = np.zeros(len(size), np.uint64)
    for k in range(_BLOCKS):
        here = np.flatnonzero(size > 8 * k) if k else np.flatnonzero(size > 0)
        if not len(here):
            break
        total[here] += mix((at[starts[here] + 8 * k] & _KEEP[np.minimum(size[here] - 8 * k, 8)]) ^ _place(np.array([k]), seed)[0])
    long = np.flatnonzero(size > 8 * _BLOCKS)
    if len(long):
        n = -(-size[long] // 8) - _BLOCKS
        for some in np.split(np.arange(len(long)), np.searchsorted(np.cumsum(n), np.arange(1, int(n.sum() >> 20) + 1) << 20)):
            m, first = n[some], starts[long[some]]
            before = np.concatenate([[0], np.cumsum(m)])
            k = np.arange(before[-1]) - np.repeat(before[:-1], m) + _BLOCKS
            block = at[np.repeat(first, m) + 8 * k] & _KEEP[np.minimum(np.repeat(size[long[some]], m) - 8 * k, 8)]
            total[long[some]] += _totals(mix(block ^ _place(k, seed)), before)
    return mix(total + size.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))


def piece_hash(raw: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each place on; every block of 8 bytes is scrambled once."""
    if width < 8:
        at = np.arange(len(raw) - width + 1)
        return span_hash(raw, at, at + width)
    blocks = mix(np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,)).copy())
    return window_hash(blocks, width - 7, (*range(0, width - 8, 8), width - 8))


def _totals(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the runs values[before[i]:before[i + 1]]."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[before[1:]] - sums[before[:-1]]


def run_hash(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of whole runs of values: run i is values[before[i]:before[i + 1]]; each value is scrambled with its place."""
    size = np.diff(before)
    place = np.arange(before[0], before[-1]) - np.repeat(before[:-1], size)
    total = _totals(mix(values[before[0] : before[-1]] ^ _place(place, 77)), before - before[0])
    return mix(total + size.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))


def window_hash(hashes: np.ndarray, width: int, taps: tuple[int, ...] | None = None) -> np.ndarray:
    """Hashes of each run of ``width`` values, over the positions in ``taps`` (all if none)."""
    m = max(0, len(hashes) - width + 1)
    total, part = np.zeros(m, np.uint64), np.empty(min(m, _NEAR), np.uint64)
    for lo in range(0, m, _NEAR):
        here = total[lo : lo + _NEAR]
        for t in taps or range(width):
            here += np.multiply(hashes[lo + t : lo + t + len(here)], U64(pow(_MUL, 2 * t + 1, 1 << 64)), out=part[: len(here)])
        here[:] = mix(here)
    return total


def distinct(values: np.ndarray, before: np.ndarray, owner_bits: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Sets of the runs values[before[i]:before[i + 1]]: without repeats, ascending, and how many come before each run.

    Of each value its first 64 - ``owner_bits`` bits count, so that run and value sort as one number.
    """
    keep, runs = U64(64 - owner_bits), 1 << owner_bits
    found, sizes = [], []
    for lo in range(0, len(before) - 1, runs):
        cut = before[lo : lo + runs + 1]
        key = np.repeat(np.arange(len(cut) - 1, dtype=np.uint64) << keep, np.diff(cut))
        key |= values[cut[0] : cut[-1]] >> U64(owner_bits)
        upto = cut - cut[0]
        ends = upto[np.searchsorted(upto, np.arange(_NEAR, upto[-1] + _NEAR, _NEAR), "right") - 1]
        for a, b in zip([0, *ends], [*ends, upto[-1]]):  # whole runs, sorted in the processor's cache
            key[a:b].sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
        sizes.append(np.diff(np.append(np.searchsorted(key, np.arange(len(cut) - 1, dtype=np.uint64) << keep), len(key))))
        key &= U64((1 << int(keep)) - 1)
        found.append(key)
    sets = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return sets, np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int64)


def overlaps(xs: np.ndarray, at: np.ndarray, ys: np.ndarray, bt: np.ndarray, owner_bits: int = 12) -> np.ndarray:
    """Sizes of the intersections of the i-th sets of two runs of sets as ``distinct`` makes them."""
    keep, runs, n = U64(64 - owner_bits), 1 << owner_bits, len(at) - 1
    out = np.zeros(n, np.int64)
    for lo in range(0, n, runs):
        parts = []
        for values, cut in ((xs, at[lo : lo + runs + 1]), (ys, bt[lo : lo + runs + 1])):
            parts.append((np.repeat(np.arange(len(cut) - 1, dtype=np.uint64), np.diff(cut)) << keep) | values[cut[0] : cut[-1]])
        key = np.concatenate(parts)
        key.sort(kind="stable")  # a merge, as both parts are ascending
        both = key[1:][key[1:] == key[:-1]]
        out[lo : lo + runs] = np.bincount((both >> keep).astype(np.int64), minlength=len(at[lo : lo + runs + 1]) - 1)
    return out
