"""Continuous-time chains and least-cost histories on rooted trees, for any number of states, many characters at once."""

from __future__ import annotations

import math

import numpy as np

CHI2_95 = 3.841458820694124  # 95 % quantile of chi-square with one degree of freedom


def expm(q: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a rational approximation of order (8, 8)."""
    norm = np.abs(q).sum(0).max(initial=0.0)
    k = max(0, int(math.ceil(math.log2(norm / 0.5)))) if norm > 0.5 else 0
    a = q / 2.0**k
    num = den = np.eye(len(q))
    power, c, order = np.eye(len(q)), 1.0, 8
    for i in range(1, order + 1):
        c *= (order - i + 1) / (i * (2 * order - i + 1))
        power = power @ a
        num, den = num + c * power, den + c * power * (-1) ** i
    out = np.linalg.solve(den, num)
    for _ in range(k):
        out = out @ out
    return out


def generator(size: int, moves: list[tuple[int, int, float]]) -> np.ndarray:
    """Rates of moves, parallel ones added; rows sum to 0."""
    q = np.zeros((size, size))
    for i, j, r in moves:
        q[i, j] += r
    q[np.diag_indices(size)] -= q.sum(1)
    return q


def equal_rates(size: int, rate: float) -> np.ndarray:
    """Every change equally likely, one change expected in a unit of length at rate 1."""
    q = np.full((size, size), rate / (size - 1))
    q[np.diag_indices(size)] = -rate
    return q


def _log_dot(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """log of p @ exp(v) for columns of logs."""
    top = v.max(0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(p @ np.exp(v - top)) + top


def prune(edges: list[tuple[str, str, float]], tips: dict[str, np.ndarray], matrix) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], str]:
    """Inside logs of every node, the message of each edge, and the root. Edges are (child, parent, length), children first.

    tips give states x characters of 0/1 compatibilities; an unknown tip is all ones. matrix(length) is cached by length.
    """
    inside = {}
    with np.errstate(divide="ignore"):
        for name, t in tips.items():
            inside[name] = np.log(np.asarray(t, float))
    sent, cache = {}, {}
    for child, parent, length in edges:
        p = cache.setdefault(length, matrix(length))
        sent[child] = _log_dot(p, inside[child])
        inside[parent] = inside[parent] + sent[child] if parent in inside else sent[child].copy()
    return inside, sent, edges[-1][1]


def log_likelihood(edges, tips, matrix, prior: np.ndarray) -> np.ndarray:
    """Of each character."""
    inside, _, root = prune(edges, tips, matrix)
    return _log_dot(prior[None, :], inside[root])[0]


def posteriors(edges, tips, matrix, prior: np.ndarray) -> dict[str, np.ndarray]:
    """Probability of each state at each node (states x characters)."""
    inside, sent, root = prune(edges, tips, matrix)
    with np.errstate(divide="ignore"):
        outside = {root: np.log(prior)[:, None] + np.zeros_like(inside[root])}
    for child, parent, length in reversed(edges):
        rest = outside[parent] + np.where(np.isneginf(sent[child]), -np.inf, 0.0)
        for other, up, _ in edges:
            if up == parent and other != child:
                rest = rest + sent[other]
        outside[child] = _log_dot(matrix(length).T, rest)
    out = {}
    for node, v in inside.items():
        w = v + outside[node]
        w = np.exp(w - w.max(0))
        out[node] = w / w.sum(0)
    return out


def sankoff(edges, tips: dict[str, np.ndarray], cost: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Least cost of each character, and the states that some optimal history has at each node (states x characters).

    tips are 0/1 compatibilities; an impossible state costs infinity, so nothing is taken off again: what the rest of
    the tree costs is summed from the siblings.
    """
    inside = {n: np.where(np.asarray(t) > 0, 0.0, np.inf) for n, t in tips.items()}
    sent = {}
    for child, parent, _ in edges:
        sent[child] = (cost[:, :, None] + inside[child][None, :, :]).min(1)
        inside[parent] = inside[parent] + sent[child] if parent in inside else sent[child].copy()
    root = edges[-1][1]
    best = inside[root].min(0)
    outside = {root: np.zeros_like(inside[root])}
    for child, parent, _ in reversed(edges):
        rest = outside[parent].copy()
        for other, up, _ in edges:
            if up == parent and other != child:
                rest = rest + sent[other]
        if parent in tips:
            rest = rest + np.where(np.asarray(tips[parent]) > 0, 0.0, np.inf)
        outside[child] = (cost[:, :, None] + rest[:, None, :]).min(0)
    return best, {n: inside[n] + outside[n] <= best + 1e-9 for n in inside}


def maximise_asking(low: float, high: float, brackets: int = 12, steps: int = 60):
    """Largest value of a function of one positive parameter: a logarithmic grid, then golden section in the best bracket.

    status: optimum, boundary_low or boundary_high. A generator: it yields lists of places and is sent the values there,
    so that many fits can go on together.
    """
    grid = np.geomspace(low, high, brackets + 1)
    values = yield list(grid)
    i = int(np.argmax(values))
    a, b = math.log(grid[max(0, i - 1)]), math.log(grid[min(brackets, i + 1)])
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = yield [math.exp(c), math.exp(d)]
    for _ in range(steps):
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            (fc,) = yield [math.exp(c)]
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            (fd,) = yield [math.exp(d)]
    x = math.exp((a + b) / 2)
    (best,) = yield [x]
    if values[i] >= best:
        x, best = float(grid[i]), values[i]
    status = "boundary_low" if x <= low * 1.001 else "boundary_high" if x >= high / 1.001 else "optimum"
    return {"x": x, "value": best, "status": status}


def maximise(f, low: float, high: float, brackets: int = 12, steps: int = 60) -> dict:
    """``maximise_asking`` of a function."""
    return answered_by(f, maximise_asking(low, high, brackets, steps))


def profile_interval_asking(x: float, value: float, low: float, high: float):
    """Where the value falls by half the 95 % quantile on either side, by bisection; null where it never does.

    A generator as ``maximise_asking``; both sides go on together.
    """
    want = value - CHI2_95 / 2
    sides = [[math.log(x), math.log(far)] if v <= want else None for far, v in zip((low, high), (yield [low, high]))]
    for _ in range(60):
        open_ = [s for s in sides if s]
        if not open_:
            break
        middles = [(a + b) / 2 for a, b in open_]
        for s, m, v in zip(open_, middles, (yield [math.exp(m) for m in middles])):
            s[0 if v > want else 1] = m
    low_at, high_at = (s and math.exp((s[0] + s[1]) / 2) for s in sides)
    return low_at, high_at


def profile_interval(f, x: float, value: float, low: float, high: float) -> tuple[float | None, float | None]:
    """``profile_interval_asking`` of a function."""
    return answered_by(f, profile_interval_asking(x, value, low, high))


def answered_by(f, asking):
    """The result of a generator that asks for values of f."""
    try:
        places = next(asking)
        while True:
            places = asking.send([f(x) for x in places])
    except StopIteration as end:
        return end.value


def chi2_tail(x: float) -> float:
    """P of chi-square with one degree of freedom above x."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))
