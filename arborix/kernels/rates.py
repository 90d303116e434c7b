"""Rates of gain and loss of two-state characters by maximum likelihood, many patterns at once; comparison of two models."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from arborix.kernels import markov

#: Bounds of rates, of what foreground branches multiply them with, and of the root's log-odds (fixed values).
RATE_MIN, RATE_MAX, TIMES_MIN, TIMES_MAX, ODDS = 1e-6, 1e3, 1e-3, 1e3, 13.8155105579
NESTED = {"ER": (1, [(0.01,), (0.1,), (1.0,)]), "ARD": (2, [(0.01, 0.1), (0.1, 0.1), (0.1, 1.0), (1.0, 0.1)]), "ARD_FOREGROUND": (3, [(0.01, 0.1, 0.5), (0.1, 0.1, 1.0), (0.1, 1.0, 2.0), (1.0, 0.1, 5.0)])}


@lru_cache(maxsize=64)
def _layers(edges: tuple[tuple[str, str, float], ...], foreground: frozenset[str]) -> tuple[tuple, ...]:
    """The edges in layers whose children are all known by then, each sorted by parent: children, lengths, foreground, where each parent begins, parents."""
    height: dict[str, int] = {}
    for child, parent, _ in edges:
        height[parent] = max(height.get(parent, 0), height.get(child, 0) + 1)
    out = []
    for h in sorted({height[p] for _, p, _ in edges}):
        rows = sorted((e for e in edges if height[e[1]] == h), key=lambda e: e[1])
        parents = [e[1] for e in rows]
        starts = [i for i, p in enumerate(parents) if not i or p != parents[i - 1]]
        out.append((tuple(e[0] for e in rows), np.array([e[2] for e in rows]), np.array([e[0] in foreground for e in rows]), np.array(starts), tuple(parents[i] for i in starts)))
    return tuple(out)


def log_likelihood(edges, known: dict[str, np.ndarray], weights: np.ndarray, gain: float, loss: float, presence: float, times: float = 1.0, foreground: frozenset[str] = frozenset()) -> float:
    """Of all patterns (known: a node's 2 x patterns of 0 and 1; an unknown tip is all ones).

    On the branches above the nodes of ``foreground`` both rates are multiplied by ``times``. A layer of the tree is a few
    operations over all its edges and patterns; children are summed as logs, so any number of them is safe.
    """
    total = gain + loss
    inside, scale = dict(known), np.zeros(len(weights))
    for children, lengths, fore, starts, parents in _layers(tuple(edges), foreground):
        moved = -np.expm1(-total * lengths * np.where(fore, times, 1.0))[:, None]
        a, b = gain / total * moved, loss / total * moved
        v = np.stack([inside[x] for x in children])
        sent = np.stack([(1 - a) * v[:, 0] + a * v[:, 1], b * v[:, 0] + (1 - b) * v[:, 1]], 1)
        logs = np.add.reduceat(np.log(np.maximum(sent, 1e-300)), starts, axis=0)
        top = logs.max(1, keepdims=True)
        scale += top.sum((0, 1))
        for x, values in zip(parents, np.exp(logs - top)):
            inside[x] = values
    root = inside[edges[-1][1]]
    return float(weights @ (np.log(np.maximum((1 - presence) * root[0] + presence * root[1], 1e-300)) + scale))


def simplex(f, start: np.ndarray, step: float = 0.5, tolerance: float = 1e-10, most: int = 2_000) -> tuple[np.ndarray, float, bool]:
    """The largest value of f near a start, by a moving simplex; whether it settled within ``most`` values."""
    n = len(start)
    points = [np.array(start, float)] + [start + step * (np.arange(n) == i) for i in range(n)]
    points = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda x: -x[0])
    used = n + 1
    while used < most:
        if abs(points[0][0] - points[-1][0]) <= tolerance * (1 + abs(points[0][0])) and max(np.abs(p[2] - points[0][2]).max() for p in points) < 1e-6:
            return points[0][2], points[0][0], True
        middle = np.mean([p[2] for p in points[:-1]], axis=0)
        worst = points[-1]
        tried = [(f(x := middle + k * (middle - worst[2])), used, x) for k in (1.0,)]
        used += 1
        best = tried[0]
        k = 2.0 if best[0] > points[0][0] else 0.5 if best[0] > worst[0] else -0.5
        if not points[0][0] >= best[0] > points[-2][0]:
            x = middle + k * (middle - worst[2])
            other = (f(x), used, x)
            used += 1
            best = max(best, other, key=lambda t: t[0])
        if best[0] > worst[0]:
            points[-1] = best
        else:
            points = [points[0]] + [(f(x := (p[2] + points[0][2]) / 2), used + i, x) for i, p in enumerate(points[1:])]
            used += n
        points.sort(key=lambda t: -t[0])
    return points[0][2], points[0][0], False


def fit(edges, known, weights, model: str, foreground: frozenset[str] = frozenset(), more: list[tuple[float, ...]] = ()) -> dict:
    """The best of several starts in logs of rates and log-odds of the root.

    `ER` has one rate, `ARD` gain and loss, `ARD_FOREGROUND` also a factor of both on the foreground branches. ``more`` are
    further starts (rates and the root's presence), such as the fit of the smaller model.
    """
    n, starts = NESTED[model]
    lows = np.array([math.log(RATE_MIN), math.log(RATE_MIN), math.log(TIMES_MIN)][:n] + [-ODDS])
    highs = np.array([math.log(RATE_MAX), math.log(RATE_MAX), math.log(TIMES_MAX)][:n] + [ODDS])

    def value(theta: np.ndarray) -> float:
        inside = np.clip(theta, lows, highs)
        r = np.exp(inside[:n])
        got = log_likelihood(edges, known, weights, r[0], r[min(n, 2) - 1], 1 / (1 + math.exp(-inside[n])), r[2] if n == 3 else 1.0, foreground)
        return got - 1e-3 * float(np.abs(theta - inside).sum())

    places = [np.array([*map(math.log, x), 0.0]) for x in starts] + [np.array([*map(math.log, x[:-1]), math.log(x[-1] / (1 - x[-1]))]) for x in more]
    theta, best, settled = max((simplex(value, x) for x in places), key=lambda x: x[1])
    theta = np.clip(theta, lows, highs)
    edge = bool((np.abs(theta - lows) < 1e-5).any() or (np.abs(theta - highs) < 1e-5).any())
    r = np.exp(theta[:n])
    return {
        "gain": float(r[0]), "loss": float(r[min(n, 2) - 1]), "times": float(r[2]) if n == 3 else 1.0, "presence": 1 / (1 + math.exp(-theta[n])), "log_likelihood": best, "parameters": n + 1,
        "status": "not_settled" if not settled else "boundary" if edge else "optimum", "aic": 2 * (n + 1) - 2 * best,
    }


def _test(null: dict, other: dict) -> tuple[str, float | None]:
    """Whether two nested fits can be compared, and the chance of their likelihood ratio (one degree of freedom)."""
    gained = other["log_likelihood"] - null["log_likelihood"]
    status = "alternative_below_null" if gained < -1e-7 else "tested" if null["status"] == other["status"] == "optimum" else "parameters_not_estimable"
    return status, round(markov.chi2_tail(2 * max(0.0, gained)), 6) if status == "tested" else None


def compare_foreground(edges, tips: list[str], patterns: list[str], weights: np.ndarray, foreground: frozenset[str]) -> dict:
    """Equal rates everywhere against a factor on the foreground branches, both with gain and loss of their own."""
    if not any("0" in p and "1" in p for p in patterns):
        return {"fit": "no_observed_contrast", "gain": None, "loss": None, "times": None, "null_loglik": None, "foreground_loglik": None, "p_value": None}
    letters = np.array([list(p) for p in patterns])
    known = {t: np.stack([letters[:, i] != "1", letters[:, i] != "0"]).astype(float) for i, t in enumerate(tips)}
    null = fit(edges, known, weights, "ARD")
    inside = min(max(null["presence"], 1e-6), 1 - 1e-6)
    other = fit(edges, known, weights, "ARD_FOREGROUND", foreground, [(null["gain"], null["loss"], 1.0, inside)])
    status, p = _test(null, other)
    return {"fit": status, "gain": round(other["gain"], 4), "loss": round(other["loss"], 4), "times": round(other["times"], 4), "null_loglik": round(null["log_likelihood"], 3), "foreground_loglik": round(other["log_likelihood"], 3), "p_value": p}


def compare(edges, tips: list[str], patterns: list[str], weights: np.ndarray) -> dict:
    """Both models, the likelihood ratio's chance (one degree of freedom) and the model of the smaller AIC."""
    none = {"fit": "no_observed_contrast", "er_rate": None, "er_loglik": None, "gain": None, "loss": None, "ard_loglik": None, "p_value": None, "chosen": None}
    if not any("0" in p and "1" in p for p in patterns):
        return none
    letters = np.array([list(p) for p in patterns])
    known = {t: np.stack([letters[:, i] != "1", letters[:, i] != "0"]).astype(float) for i, t in enumerate(tips)}
    er, ard = fit(edges, known, weights, "ER"), fit(edges, known, weights, "ARD")
    status, chance = _test(er, ard)
    valid = [(f["aic"], name) for name, f in (("ER", er), ("ARD", ard)) if f["status"] == "optimum"]
    return {
        "fit": status, "er_rate": round(er["gain"], 4), "er_loglik": round(er["log_likelihood"], 3), "gain": round(ard["gain"], 4), "loss": round(ard["loss"], 4), "ard_loglik": round(ard["log_likelihood"], 3),
        "p_value": chance, "chosen": min(valid)[1] if valid else None,
    }
