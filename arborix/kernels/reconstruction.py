"""Histories over configuration spaces: scenarios of what was observed, least-cost reconstruction, sampled histories."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import replace
from itertools import product

import numpy as np

from arborix.kernels import configurations as X, markov

OBSERVATIONS = 64


def observation_scenarios(options: dict[str, list], limit: int = OBSERVATIONS) -> list[dict]:
    """One choice for each tip out of its coexisting structures, all combinations; more than the limit are refused."""
    if math.prod(len(v) for v in options.values()) > limit:
        raise X.Refused("observation_scenarios_incomplete")
    names = sorted(options)
    return [dict(zip(names, c)) for c in product(*(options[n] for n in names))]


def _permitted(space: X.Space, arriving: frozenset[str]) -> X.Space:
    """The edits of a branch: a tract arrives only on the one that it is assigned to."""
    return replace(space, edits=[e for e in space.edits if e[2] != "dna_insertion" or e[3] in arriving])


def _costs(space: X.Space, arriving: frozenset[str], cost: dict[str, float] | None) -> np.ndarray:
    return X.edit_distances(_permitted(space, arriving), cost)


def reconstruct(space: X.Space, edges, tips: dict[str, np.ndarray], cost: dict[str, float] | None = None, limit: int = X.ORIGINS) -> dict:
    """Least edits over all origins of the tracts, and for each branch and edit its least and most occurrences in any optimum.

    Edits are told apart by what they change, so two shifts of one branch are two.

    An event is required on a branch if every optimal history has it there, possible if some has. What is possible on
    several branches is never summed.
    """
    root = edges[-1][1]
    names = [t[0] for t in space.catalogue.tracts]
    cache: dict[frozenset, np.ndarray] = {}
    best, optima = math.inf, defaultdict(list)
    for origin, fits in X.origins(space, edges, tips, limit):
        start = np.where(fits, 0.0, math.inf)
        at = {c: frozenset(n for n, v in zip(names, origin) if v == c) for c, _, _ in edges}
        for a in at.values():
            if a not in cache:
                cache[a] = _costs(space, a, cost)
        inside = {n: np.where(np.asarray(v) > 0, 0.0, math.inf) for n, v in tips.items()}
        sent: dict[str, np.ndarray] = {}
        for child, parent, _ in edges:
            sent[child] = (cache[at[child]] + inside[child][None, :]).min(1)
            inside[parent] = inside[parent] + sent[child] if parent in inside else sent[child].copy()
        total = float((inside[root] + start).min())
        if not math.isfinite(total) or total > best + 1e-9:
            continue
        if total < best - 1e-9:
            best, optima = total, defaultdict(list)
        outside = {root: start}
        kids = defaultdict(list)
        for child, parent, _ in edges:
            kids[parent].append(child)
        for child, parent, _ in reversed(edges):
            rest = outside[parent].copy()
            for other in kids[parent]:
                if other != child:
                    rest = rest + sent[other]
            d = cache[at[child]]
            outside[child] = (rest[:, None] + d).min(0)
            ends = np.argwhere(rest[:, None] + d + inside[child][None, :] <= total + 1e-9)
            part = _permitted(space, at[child])
            optima[child] += [X.event_bounds(part, d, int(i), int(j), cost) for i, j in ends]
    events = []
    for branch, ways in sorted(optima.items()):
        for e in sorted({e for w in ways for e in w}):
            low, high = min(w.get(e, (0, 0))[0] for w in ways), max(w.get(e, (0, 0))[1] for w in ways)
            events.append({"branch": branch, "kind": e.split()[0], "event": e, "least": low, "most": high, "call": "required" if low else "possible"})
    return {"min_edits": best if math.isfinite(best) else None, "events": events}


def expected_changes(q: np.ndarray, length: float) -> np.ndarray:
    """Expected number of changes along a branch from i to j, times the probability of the branch, by a block exponential."""
    n = len(q)
    moves = q.copy()
    moves[np.diag_indices(n)] = 0
    block = np.zeros((2 * n, 2 * n))
    block[:n, :n] = block[n:, n:] = q
    block[:n, n:] = moves
    return markov.expm(block * length)[:n, n:]


def sample_branch(q: np.ndarray, length: float, start: int, end: int, rng: np.random.Generator) -> list[tuple[float, int]]:
    """A history between two states as (time, new state), by uniformisation: a number of virtual steps, then the states between.

    A branch with more than 200 expected virtual steps is halved until it has fewer, its middle state drawn from both
    halves, so that no weight underflows and the series ends by itself, without a limit of steps.
    """
    rate = float(-q.diagonal().min()) or 1.0
    if rate * length > 200:
        half = markov.expm(q * (length / 2))
        weights = np.maximum(half[start] * half[:, end], 0.0)
        middle = int(rng.choice(len(q), p=weights / weights.sum()))
        later = sample_branch(q, length / 2, middle, end, rng)
        return sample_branch(q, length / 2, start, middle, rng) + [(t + length / 2, s) for t, s in later]
    step = np.eye(len(q)) + q / rate
    want, total, weight = rng.random(), 0.0, math.exp(-rate * length)
    whole = float(markov.expm(q * length)[start, end])
    powers = [np.eye(len(q))]
    while total + weight * powers[-1][start, end] < want * whole * (1 - 1e-12) and weight > 0:
        total += weight * powers[-1][start, end]
        weight *= rate * length / len(powers)
        powers.append(powers[-1] @ step)
    k = len(powers) - 1
    times = np.sort(rng.random(k)) * length
    out, at = [], start
    for i in range(k):
        p = step[at] * powers[k - i - 1][:, end]
        new = int(rng.choice(len(q), p=p / p.sum()))
        if new != at:
            out.append((float(times[i]), new))
            at = new
    return out


def sample_history(edges, tips: dict[str, np.ndarray], q: np.ndarray, prior: np.ndarray, rng: np.random.Generator) -> dict[str, list[tuple[float, int]]]:
    """One history of one character on all branches, drawn from its posterior (tips: states x 1)."""
    inside, _, root = markov.prune(edges, tips, lambda t: markov.expm(q * t))
    draw = lambda w: int(rng.choice(len(w), p=w / w.sum()))
    state = {root: draw(prior * np.exp(inside[root][:, 0] - inside[root].max()))}
    out = {}
    for child, parent, length in reversed(edges):
        v = np.exp(inside[child][:, 0] - inside[child].max())
        state[child] = draw(markov.expm(q * length)[state[parent]] * v)
        out[child] = sample_branch(q, length, state[parent], state[child], rng)
    return out
