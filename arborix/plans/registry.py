"""All queries of the core, by name."""

from __future__ import annotations

from arborix.plans import correspondence, evidence, kernels, matches, problems, sequences, structure, trees

MODULES = [problems, structure, matches, trees, sequences, kernels, evidence, correspondence]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
