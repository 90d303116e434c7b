"""JSON files that appear whole, and the record of a run."""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from pathlib import Path


def finite(value):
    """The value with NaN and infinities as null, at any depth."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): finite(v) for k, v in value.items()}
    return [finite(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_json(path: str | Path, value) -> None:
    """Sorted keys, written beside the target and renamed."""
    path = Path(path)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(finite(value), sort_keys=True, indent=1, allow_nan=False) + "\n")
    os.replace(part, path)


class Run:
    """A record that says running, then completed or failed (with the error), and the artifacts made on the way.

    The record is written last, so a reader that finds `completed` finds the artifacts.
    """

    def __init__(self, path: str | Path, **about):
        self.path, self.record = Path(path), {"status": "running", "artifacts": {}, **about}

    def artifact(self, name: str, where: str, rows: int | None = None) -> None:
        self.record["artifacts"][name] = {"path": where, "rows": rows}

    def __enter__(self) -> "Run":
        self.record["started"] = time.time()
        write_json(self.path, self.record)
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.record |= {"status": "failed" if kind else "completed", "ended": time.time()} | ({"error": f"{kind.__name__}: {error}"} if kind else {})
        write_json(self.path, self.record)
