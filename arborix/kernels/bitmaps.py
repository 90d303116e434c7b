"""Compressed bitmaps over ranges of 2**15 keys, and set algebra on them.

A bitmap is one container, whichever is smallest: an array of 16-bit positions, runs as pairs of start and length less one,
or the 4 KB of all bits. The first byte tells which.
"""

from __future__ import annotations

import numpy as np

BITS = 1 << 15
ARRIVED, WITHDRAWN, REFERENCED = 0, 1, 2
ARRAY, RUNS, DENSE = b"A", b"R", b"B"


def encode(positions: np.ndarray) -> bytes:
    """The container of ascending positions without repeats."""
    n = len(positions)
    breaks = np.flatnonzero(np.diff(positions) != 1)
    if 4 * (len(breaks) + 1) < min(2 * n, BITS // 8):
        starts, ends = positions[np.append(0, breaks + 1)], positions[np.append(breaks, n - 1)]
        return RUNS + np.stack([starts, ends - starts], 1).astype("<u2").tobytes()
    if 2 * n < BITS // 8:
        return ARRAY + positions.astype("<u2").tobytes()
    bits = np.zeros(BITS, np.uint8)
    bits[positions] = 1
    return DENSE + np.packbits(bits, bitorder="little").tobytes()


def _runs(container: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(container, "<u2", offset=1).reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1] + 1


def decode(container: bytes) -> np.ndarray:
    """The positions of a container, ascending."""
    kind = container[:1]
    if kind == ARRAY:
        return np.frombuffer(container, "<u2", offset=1).astype(np.int64)
    if kind == RUNS:
        starts, lengths = _runs(container)
        return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little"))


def contains(container: bytes, positions: np.ndarray) -> np.ndarray:
    """Whether each position is in a container, without unfolding it."""
    kind = container[:1]
    if kind == DENSE:
        raw = np.frombuffer(container, np.uint8, offset=1)
        return (raw[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1
    starts, lengths = _runs(container) if kind == RUNS else (decode(container), None)
    if not len(starts):
        return np.zeros(len(positions), bool)
    at = np.maximum(np.searchsorted(starts, positions, side="right") - 1, 0)
    return (positions >= starts[at]) & (positions < starts[at] + (1 if lengths is None else lengths[at]))


def union(a: bytes, b: bytes) -> bytes:
    if a[:1] == b[:1] == DENSE:
        return DENSE + (np.frombuffer(a, np.uint8, offset=1) | np.frombuffer(b, np.uint8, offset=1)).tobytes()
    return encode(np.union1d(decode(a), decode(b)))


def and_not(a: bytes, b: bytes) -> bytes:
    """What is in a and not in b; two dense containers byte by byte, otherwise the positions of a are looked up in b."""
    if a[:1] == b[:1] == DENSE:
        return DENSE + (np.frombuffer(a, np.uint8, offset=1) & ~np.frombuffer(b, np.uint8, offset=1)).tobytes()
    positions = decode(a)
    return encode(positions[~contains(b, positions)])


EMPTY = encode(np.empty(0, np.int64))


def build(ids: np.ndarray, kinds: np.ndarray, periods: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(key range, kind, period, container) of many events; ids, kinds and periods run in parallel, repeats count once."""
    order = np.lexsort((ids, periods, kinds, ids >> 15))
    ranges, kinds, periods, ids = ids[order] >> 15, kinds[order], periods[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ranges) != 0) | (np.diff(kinds) != 0) | (np.diff(periods) != 0)
    starts = np.flatnonzero(new)
    return [(int(ranges[a]), int(kinds[a]), int(periods[a]), encode(np.unique(ids[a:b]) & (BITS - 1))) for a, b in zip(starts, np.append(starts[1:], len(ids)))]


def not_present(kinds: np.ndarray, periods: np.ndarray, bitmaps: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(period, positions) of the references AND NOT parents of one key range, period by period.

    A parent counts as present in a period only if it arrived in an earlier one and isn't withdrawn by the end of this
    one, so every reference that may be an orphan survives; times inside a period are left to an exact check.
    """
    arrived = withdrawn = EMPTY
    out = []
    for p in np.unique(periods):
        here = np.flatnonzero(periods == p)
        for i in here:
            if kinds[i] == WITHDRAWN:
                withdrawn = union(withdrawn, bitmaps[i])
        present = and_not(arrived, withdrawn)
        for i in here:
            if kinds[i] == REFERENCED:
                left = decode(and_not(bitmaps[i], present))
                if len(left):
                    out.append((int(p), left))
        for i in here:
            if kinds[i] == ARRIVED:
                arrived = union(arrived, bitmaps[i])
    return out
