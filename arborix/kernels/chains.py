"""Colinear chains of candidate matches, and clusters whose members must all be compatible."""

from __future__ import annotations

import heapq
import math

import numpy as np

SLACK, SHARE = 4.0, 0.05


class _Best:
    """The largest value among places below one, with who has it: a tree of prefix maxima."""

    def __init__(self, n: int):
        self.value, self.who = [-math.inf] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, value: float, who: int) -> None:
        at += 1
        while at < len(self.value):
            if value > self.value[at]:
                self.value[at], self.who[at] = value, who
            at += at & -at

    def below(self, at: int) -> tuple[float, int]:
        best, who = -math.inf, -1
        while at:
            if self.value[at] > best:
                best, who = self.value[at], self.who[at]
            at -= at & -at
        return best, who


def _ahead(lo1, hi1, lo2, hi2, score) -> tuple[np.ndarray, np.ndarray]:
    """Best score of a chain that ends with each candidate, and the candidate before it: a sweep over the first side.

    A candidate becomes available once the sweep is past its end; of those, the best that ends before on the second side
    is a prefix maximum, so a candidate costs the logarithm of their number.
    """
    n = len(score)
    best, back = score.astype(float), np.full(n, -1)
    ends = np.unique(hi2)
    rank, upto = np.searchsorted(ends, hi2), np.searchsorted(ends, lo2)
    tree, waiting = _Best(len(ends)), []
    for i in np.lexsort((lo2, lo1)):
        while waiting and waiting[0][0] < lo1[i]:
            _, j = heapq.heappop(waiting)
            tree.put(int(rank[j]), best[j], j)
        value, j = tree.below(int(upto[i]))
        if value > 0:
            best[i], back[i] = score[i] + value, j
        heapq.heappush(waiting, (hi1[i], int(i)))
    return best, back


def chain(q1: np.ndarray, q2: np.ndarray, t1: np.ndarray, t2: np.ndarray, score: np.ndarray) -> dict:
    """Best chain of candidates that follow each other strictly on both sides, and what stays near it.

    through[i] is the best score of a chain with candidate i; retained are those within max(4, 5 % of the best);
    obligatory are those without which the best falls by more. A chain near the best has retained members alone, so
    what is left without one of them is sought among them: a chain that steps over it, or lies on one side of it.
    """
    n = len(score)
    if not n:
        return {"best": 0.0, "through": np.empty(0), "retained": np.empty(0, bool), "obligatory": np.empty(0, bool), "path": []}
    ahead, back = _ahead(q1, q2, t1, t2, score)
    behind, _ = _ahead(-q2, -q1, -t2, -t1, score)
    through = ahead + behind - score
    top = float(ahead.max())
    enough = top - max(SLACK, SHARE * top) - 1e-9
    retained = through >= enough
    obligatory = np.zeros(n, bool)
    kept = np.flatnonzero(retained)
    kept = kept[np.lexsort((t1[kept], q1[kept]))]
    m = len(kept)
    # over[k] counts the ways past place k: +1 behind a step's first member, -1 at its second
    over = np.zeros(m + 1, np.int64)
    a, b = ahead[kept], behind[kept]
    first = np.flatnonzero(a >= enough)  # a chain that ends here passes all later places
    np.add.at(over, first + 1, 1)
    last = np.flatnonzero(b >= enough)  # one that begins here, all earlier ones
    over[0] += len(last)
    np.add.at(over, last, -1)
    for k in range(m):
        j = np.flatnonzero((q2[kept[:k]] < q1[kept[k]]) & (t2[kept[:k]] < t1[kept[k]]) & (a[:k] + b[k] >= enough))
        np.add.at(over, j + 1, 1)
        over[k] -= len(j)
    obligatory[kept] = np.cumsum(over[:m]) == 0
    path, i = [], int(ahead.argmax())
    while i >= 0:
        path.append(i)
        i = int(back[i])
    return {"best": top, "through": through, "retained": retained, "obligatory": obligatory, "path": path[::-1]}


def best_two_paths(q1: np.ndarray, q2: np.ndarray, t1: np.ndarray, t2: np.ndarray, score: np.ndarray) -> list[tuple[float, tuple[int, ...]]]:
    """The two best distinct chains that cannot be prolonged, best first; equal ones in order of their members.

    Every candidate keeps its two best chains; a chain is complete if nothing lies before its first, between two
    neighbours or behind its last member.
    """
    n = len(score)
    follows = (q2[:, None] < q1[None, :]) & (t2[:, None] < t1[None, :])
    next_to = follows & ~((follows.astype(np.int64) @ follows.astype(np.int64)) > 0)
    ways: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
    for i in np.lexsort((t1, q1)):
        before = [w for j in np.flatnonzero(next_to[:, i]) for w in ways[int(j)]] or [(0.0, ())]
        ways[int(i)] = sorted(((s + float(score[i]), (*p, int(i))) for s, p in before), key=lambda w: (-w[0], w[1]))[:2]
    done = [w for i in range(n) if not follows[i].any() for w in ways[i]]
    return sorted(done, key=lambda w: (-w[0], w[1]))[:2]


def greedy_clusters(edges: list[tuple[float, float, str, str]], owner: dict[str, str], allowed: set[frozenset[str]] = frozenset()) -> dict[str, str]:
    """Member to cluster (its smallest member). Edges are (distance, score, left, right).

    In order of distance, falling score and ids, two clusters join only if every cross pair is compatible: of different
    owners with a direct edge, or declared in ``allowed``; of one owner only if declared. Each cluster carries the records
    that fit all its members, the intersection of theirs, so a join is one test of a subset.
    """
    fitting: dict[str, set[str]] = {x: set() for _, _, a, b in edges for x in (a, b)}
    pairs = {(a, b) for _, _, a, b in edges if a != b and owner.get(a) != owner.get(b)}
    for a, b in pairs | {tuple(sorted(p)) for p in allowed if len(p) == 2}:
        if a in fitting and b in fitting:
            fitting[a].add(b)
            fitting[b].add(a)
    cluster = {x: (frozenset([x]), frozenset(others)) for x, others in fitting.items()}
    for _, _, a, b in sorted((d, -s, *sorted((a, b))) for d, s, a, b in edges):
        (mine, open_mine), (theirs, open_theirs) = cluster[a], cluster[b]
        if theirs <= open_mine:
            joined = (mine | theirs, open_mine & open_theirs)
            for x in joined[0]:
                cluster[x] = joined
    return {x: min(members) for x, (members, _) in cluster.items()}


def local_members(blocks: list[tuple[str, str, int, int]], matches: list[tuple[str, str]]) -> dict[str, str]:
    """Blocks (id, segment, start, end) of one element to local elements: the two sides of a match belong together, and
    overlapping blocks of one segment. A local element is named by its smallest block."""
    up = {b[0]: b[0] for b in blocks}

    def find(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(a: str, b: str) -> None:
        a, b = sorted((find(a), find(b)))
        up[b] = a

    for a, b in matches:
        if a in up and b in up:
            join(a, b)
    last: dict[str, tuple[int, str]] = {}
    for name, segment, start, end in sorted(blocks, key=lambda x: (x[1], x[2], x[3], x[0])):
        if segment in last and start <= last[segment][0]:
            join(name, last[segment][1])
            end = max(end, last[segment][0])
        last[segment] = (end, name)
    return {x: find(x) for x in up}
