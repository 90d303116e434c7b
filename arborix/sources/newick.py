"""Newick trees to node rows. A tree is one line of text, parsed without recursion."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"\s*(?:(\[[^\]]*\])|([(),;:])|'((?:[^']|'')*)'|([^\s(),;:\[\]']+))")


def parse(text: str) -> list[tuple[str, str | None, str, float | None]]:
    """node_id, parent_id, label, branch_length in preorder; nodes are numbered node_1, node_2, …; the root's length is 0.

    Brackets hold comments; quotes may hold any sign. A negative or non-finite length, or text that is no tree, is an error.
    """
    nodes: list[dict] = [{"up": None, "label": "", "length": None, "kids": []}]
    at, pos, expect_length, closed = nodes[0], 0, False, False
    text = text.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or closed:
            raise ValueError(f"no tree at {pos}: {text[pos : pos + 20]!r}")
        pos = m.end()
        comment, sign, quoted, word = m.groups()
        if comment is not None:
            continue
        if sign == "(" or sign == ",":
            up = at if sign == "(" else at["up"]
            if up is None:
                raise ValueError("a comma outside the root")
            at = {"up": up, "label": "", "length": None, "kids": []}
            up["kids"].append(at)
            nodes.append(at)
        elif sign == ")":
            if at["up"] is None:
                raise ValueError("a bracket closes that was not opened")
            at = at["up"]
        elif sign == ":":
            expect_length = True
        elif sign == ";":
            closed = True
        else:
            value = quoted.replace("''", "'") if quoted is not None else word
            if expect_length:
                n = float(value)
                if not math.isfinite(n) or n < 0:
                    raise ValueError(f"branch length {value}")
                at["length"], expect_length = n, False
            else:
                at["label"] = value
    if at is not nodes[0]:
        raise ValueError("a bracket isn't closed")
    order, stack = [], [nodes[0]]
    while stack:
        x = stack.pop()
        x["id"] = f"node_{len(order) + 1}"
        order.append(x)
        stack += reversed(x["kids"])
    return [(x["id"], x["up"]["id"] if x["up"] else None, x["label"], 0.0 if x["up"] is None else x["length"]) for x in order]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """file_name, tree (hash of its line), node_id, parent_id, label, branch_length; a tree a line."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_name").alias("file_name"), F.sha2("value", 256).substr(1, 12).alias("tree"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, t, *n) for f, t, v in pdf.itertuples(index=False) for n in parse(v)]
            yield pd.DataFrame(rows, columns=["file_name", "tree", "node_id", "parent_id", "label", "branch_length"])

    return lines.mapInPandas(run, "file_name string, tree string, node_id string, parent_id string, label string, branch_length double")
