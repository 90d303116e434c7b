"""Aligned rows: maps between bases and columns, supported runs, gap qualification, ungapped hits."""

from __future__ import annotations

import re

import numpy as np

# Fixed values of gap qualification.
FLANK, LEAST_IDENTITY = 12, 0.8


def _known(row: str) -> np.ndarray:
    return np.isin(np.frombuffer(row.upper().encode("ascii", "replace"), np.uint8), np.frombuffer(b"ACGT", np.uint8))


def column_map(row: str) -> np.ndarray:
    """Column (from 0) of each base of an aligned row."""
    return np.flatnonzero(np.frombuffer(row.encode("ascii", "replace"), np.uint8) != ord("-"))


def runs(row: str, pattern: str = "-+") -> list[tuple[int, int]]:
    """Half-open columns of the maximal runs of a pattern."""
    return [m.span() for m in re.finditer(pattern, row)]


def supported_runs(a: str, b: str) -> list[tuple[int, int]]:
    """Half-open columns of the maximal runs in which both rows have known bases."""
    good = np.concatenate([[False], _known(a) & _known(b), [False]])
    edges = np.flatnonzero(good[1:] != good[:-1])
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2])]


def paired_support(a: str, b: str, start: int, end: int) -> tuple[int, float | None]:
    """Columns with known bases in both rows, and the equal share of them."""
    x, y = a[start:end].upper(), b[start:end].upper()
    both = _known(x) & _known(y)
    n = int(both.sum())
    if not n:
        return 0, None
    same = np.frombuffer(x.encode(), np.uint8) == np.frombuffer(y.encode(), np.uint8)
    return n, float((same & both).sum() / n)


def gap_qualified(rows: dict[str, str], name: str, start: int, end: int) -> bool:
    """A gap over all the columns whose two flanks have 12 known pairs of enough identity with one row that has no gap there."""
    own = rows[name]
    if set(own[start:end]) != {"-"}:
        return False
    for other, row in rows.items():
        if other == name or "-" in row[start:end]:
            continue
        for side in (range(start - 1, -1, -1), range(end, len(own))):
            pairs = [(own[i].upper(), row[i].upper()) for i in side if own[i].upper() in "ACGT" and row[i].upper() in "ACGT"][:FLANK]
            if len(pairs) < FLANK or sum(x == y for x, y in pairs) / FLANK < LEAST_IDENTITY:
                break
        else:
            return True
    return False


def best_hit(query: str, target: str) -> tuple[int, float] | None:
    """Start (from 1) and identity of the best ungapped place of the query in the target, the first of equal ones; N never matches."""
    q, t = np.frombuffer(query.upper().encode(), np.uint8), np.frombuffer(target.upper().encode(), np.uint8)
    if not len(q) or len(q) > len(t):
        return None
    known = _known(query)
    windows = np.lib.stride_tricks.sliding_window_view(t, len(q))
    share = ((windows == q) & known).sum(1) / len(q)
    at = int(share.argmax())
    return at + 1, float(share[at])


def tracts(rows: dict[str, str], least: int = 1) -> list[tuple[int, int, dict[str, int | None]]]:
    """Variable stretches of an alignment: (start, end, presence of each row), half-open columns that don't overlap.

    Borders are those of all gap runs; a row is present (1) with a base in the stretch, absent (0) with a qualified gap
    over all of it, otherwise unknown (null). Stretches without a qualified gap are left out.
    """
    width = len(next(iter(rows.values())))
    cuts = sorted({0, width, *(x for r in rows.values() for run in runs(r) for x in run)})
    out = []
    for s, e in zip(cuts, cuts[1:]):
        if e - s < least:
            continue
        state = {}
        for name, row in rows.items():
            part = row[s:e]
            left = next((a for a, b in runs(row) if a <= s and e <= b), None)
            if set(part) == {"-"}:
                a, b = next((a, b) for a, b in runs(row) if a <= s and e <= b) if left is not None else (s, e)
                state[name] = 0 if gap_qualified(rows, name, a, b) else None
            else:
                state[name] = 1 if _known(part).any() else None
        if 0 in state.values() and 1 in state.values():
            out.append((s, e, state))
    return out


def aligned_rows(query: str, target: str, cigar: str) -> tuple[str, str]:
    """The two rows of an alignment from its CIGAR.

    M, = and X take a base of both, I of the query, D and N of the target; S takes query bases that stand in no column; H and
    P take nothing. A number may be left out (1). Bases that the CIGAR doesn't reach stand in no column either.
    """
    a, b, i, j = [], [], 0, 0
    for number, op in re.findall(r"(\d*)([MIDNSHP=X])", cigar):
        n = int(number or 1)
        from_query, from_target = op in "M=XIS", op in "M=XDN"
        if op in "MIDN=X":
            a.append(query[i : i + n].ljust(n, "N") if from_query else "-" * n)
            b.append(target[j : j + n].ljust(n, "N") if from_target else "-" * n)
        i, j = i + n * from_query, j + n * from_target
    return "".join(a), "".join(b)
