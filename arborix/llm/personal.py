"""Personal information in a text column: the values by type, and the text with placeholders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborix.llm import pii
from arborix.llm.spread import spread


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("binary").alias("_text")))


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[object, str | None]]:
    for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
        raw = b.as_py()
        yield k, None if raw is None else raw.decode("utf-8", "replace")


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key, pii_type and pii_value of each value as it stands in the text, once a row of ``df``.

    Null and empty texts give no rows. The work is one pass over the rows in Arrow batches, without a shuffle; time and
    memory follow the length of a text. Bytes that aren't UTF-8 are read as U+FFFD. Rows whose key repeats are
    searched each for itself; the caller removes repeats where the same key may stand in several rows.
    """
    rows = _rows(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[object, str, str], None] = {}
            for k, t in _decoded(batch):
                for a, b, what in pii.find(t):
                    out[k, what, t[a:b]] = None
            ks, types, values = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ks, batch.column(0).type), pa.array(types, pa.string()), pa.array(values, pa.string())], names=[key, "pii_type", "pii_value"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, pii_type string, pii_value string")


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key, the text with a typed placeholder in the place of each value (`redacted`), and how many there were.

    One result row for each row; a null text stays null, an empty one empty.
    """
    rows = _rows(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for _, t in _decoded(batch):
                spans = pii.find(t)
                texts.append(pii.redact(t, spans) if t else t)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[key, "redacted", "n_found"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, redacted string, n_found int")
