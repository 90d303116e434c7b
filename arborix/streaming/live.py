"""The operators that keep their meaning on a stream: row rejects, windowed counts with late rows, sessions, first deliveries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from arborix.sources import rejects


def parsed_lines(stream: DataFrame, key: str, line: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and failures of a stream of raw lines; both are maps of single rows, without state."""
    parsed = rejects.parse_lines(stream, key, line)
    return rejects.valid_rows(parsed), rejects.failures(parsed, "raw_feature_lines")


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows a window and group; rows later than the watermark are left out, and a window's state ends with it."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, at: str, user: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user that end after a gap."""
    rows = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n_events"))
    return rows.select(user, F.col("session_window.start").alias("first_at"), "n_events")


def first_deliveries(stream: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """The first row of each key; redelivered ones within the watermark are left out."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def running_reach(stream: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals of each key that open a new island against all seen before them (state: the largest end so far).

    For sources that deliver each key in order of start; a row that comes out of order is compared with the reach alike.
    """
    fields = f"`{key}` string, start_pos long, reach long, opens boolean"

    def step(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reach = state.get[0] if state.exists else None
        rows = []
        for pdf in pdfs:
            for s, e in sorted(zip(pdf[start], pdf[end])):
                rows.append((k[0], s, reach, reach is None or s > reach + 1))
                reach = e if reach is None else max(reach, e)
        state.update((int(reach),))
        yield pd.DataFrame(rows, columns=[key, "start_pos", "reach", "opens"]).astype({"reach": "Int64"})

    return stream.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(key).applyInPandasWithState(step, fields, "reach long", "append", "NoTimeout")
