"""Affine pairwise alignment of short sequences: row by row in numpy, all optimal alignments up to a limit."""

from __future__ import annotations

import numpy as np

# Fixed values of the scoring scheme; a gap's first base costs OPEN, each further one EXTEND; N scores 0 with anything.
MATCH, MISMATCH, OPEN, EXTEND = 2, -3, -7, -2
CELLS, ALIGNMENTS = 250_000, 64
NONE = -(10**9)
_CODE = {c: i for i, c in enumerate("ACGT")}


def _codes(seq: str) -> np.ndarray:
    return np.array([_CODE.get(c, 4) for c in seq.upper().replace("U", "T")], np.int8)


def _pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = np.where(a[:, None] == b[None, :], MATCH, MISMATCH)
    s[(a == 4)[:, None] | (b == 4)[None, :]] = 0
    return s.astype(np.int64)


def tables(a: str, b: str, local: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores that end in a pair (M), in a base of a alone (A) and in a base of b alone (B).

    B depends on its own row: the running maximum of M and A less the extension so far gives the whole row at once.
    """
    x, y = _codes(a), _codes(b)
    n, m = len(x), len(y)
    score = _pair_scores(x, y)
    M, A, B = (np.full((n + 1, m + 1), NONE, np.int64) for _ in range(3))
    M[0, 0] = 0
    if local:
        M[0, :] = M[:, 0] = 0
    step = EXTEND * np.arange(m + 1)

    def along(i: int) -> None:
        src = np.maximum(M[i], A[i]) - step
        B[i, 1:] = np.maximum.accumulate(src)[:-1] + step[1:] - EXTEND + OPEN
        np.maximum(B[i], NONE, out=B[i])

    along(0)
    for i in range(1, n + 1):
        A[i] = np.maximum(np.maximum(M[i - 1], B[i - 1]) + OPEN, A[i - 1] + EXTEND)
        before = np.maximum(np.maximum(M[i - 1], A[i - 1]), B[i - 1])[:-1]
        if local:
            before = np.maximum(before, 0)
        M[i, 1:] = before + score[i - 1]
        if local:
            M[i] = np.maximum(M[i], 0)
        along(i)
    return M, A, B


def align(a: str, b: str, local: bool = False, cells: int = CELLS, limit: int = ALIGNMENTS) -> dict:
    """score, status and cigars (all optimal alignments, distinct, in order) with where they begin and end.

    status: complete, too_many (more optimal alignments than the limit; none is returned), budget (more cells than
    allowed; nothing computed) or empty.
    """
    out = {"score": None, "status": "empty", "alignments": []}
    if not a or not b:
        return out
    if len(a) * len(b) > cells:
        return out | {"status": "budget"}
    M, A, B = tables(a, b, local)
    score = _pair_scores(_codes(a), _codes(b))
    T = (M, A, B)
    if local:
        best = int(M.max())
        if best <= 0:
            return out | {"score": 0, "status": "complete"}
        ends = [(int(i), int(j), 0) for i, j in np.argwhere(M == best)]
    else:
        best = int(max(t[-1, -1] for t in T))
        ends = [(len(a), len(b), k) for k in range(3) if T[k][-1, -1] == best]
    found: dict[tuple, None] = {}
    stack = [(i, j, k, i, j, ()) for i, j, k in ends]
    while stack:
        i, j, k, ie, je, ops = stack.pop()
        here = T[k][i, j]
        if k == 0 and ((local and here == 0) or (i == 0 and j == 0)):
            found[(i, ie, j, je, unlink(ops))] = None
            if len(found) > limit:
                return out | {"score": best, "status": "too_many"}
            continue
        if k == 0:
            if i and j:
                s = score[i - 1, j - 1]
                fresh = local and here == s
                if fresh:
                    stack.append((i - 1, j - 1, 0, ie, je, ("M", ops))) if M[i - 1, j - 1] == 0 else found.setdefault((i - 1, ie, j - 1, je, unlink(("M", ops))))
                    if len(found) > limit:
                        return out | {"score": best, "status": "too_many"}
                for q in range(3):
                    if T[q][i - 1, j - 1] > NONE // 2 and T[q][i - 1, j - 1] + s == here and not (fresh and T[q][i - 1, j - 1] == 0):
                        stack.append((i - 1, j - 1, q, ie, je, ("M", ops)))
        elif k == 1 and i:
            for q, cost in ((0, OPEN), (2, OPEN), (1, EXTEND)):
                if T[q][i - 1, j] > NONE // 2 and T[q][i - 1, j] + cost == here:
                    stack.append((i - 1, j, q, ie, je, ("I", ops)))
        elif k == 2 and j:
            for q, cost in ((0, OPEN), (1, OPEN), (2, EXTEND)):
                if T[q][i, j - 1] > NONE // 2 and T[q][i, j - 1] + cost == here:
                    stack.append((i, j - 1, q, ie, je, ("D", ops)))
    rows = [{"a_start": s + 1, "a_end": e, "b_start": t + 1, "b_end": f, "cigar": cigar(ops)} for s, e, t, f, ops in sorted(found)]
    return {"score": best, "status": "complete", "alignments": rows}


def unlink(ops) -> str:
    """The operations of a linked path, as text."""
    out = []
    while ops:
        out.append(ops[0])
        ops = ops[1]
    return "".join(out)


def cigar(ops) -> str:
    """Run lengths of operations."""
    out, last, n = [], "", 0
    for o in (*ops, ""):
        if o != last:
            if n:
                out.append(f"{n}{last}")
            last, n = o, 0
        n += 1
    return "".join(out)


def statistics(a: str, b: str, row: dict) -> dict:
    """matches, mismatches, gaps, identity (over matches, mismatches and gap bases), coverage of the shorter side."""
    i, j = row["a_start"] - 1, row["b_start"] - 1
    same = different = gaps = n = 0
    for c in row["cigar"]:
        if c.isdigit():
            n = n * 10 + int(c)
            continue
        if c == "M":
            for x, y in zip(a[i : i + n].upper(), b[j : j + n].upper()):
                if x in "ACGT" and y in "ACGT":
                    same, different = same + (x == y), different + (x != y)
            i, j = i + n, j + n
        else:
            gaps += n
            i, j = (i + n, j) if c == "I" else (i, j + n)
        n = 0
    total = same + different + gaps
    return {"matches": same, "mismatches": different, "gap_bases": gaps, "identity": same / total if total else None, "coverage": min((row["a_end"] - row["a_start"] + 1) / len(a), (row["b_end"] - row["b_start"] + 1) / len(b))}
