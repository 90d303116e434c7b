"""Encoding of a text column with a public byte-level BPE vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborix.llm.bpe import Encoder
from arborix.llm.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODERS: dict[str, Encoder] = {}


def _encoder(digest: str, raw) -> Encoder:
    """One encoder a Python worker."""
    if digest not in _ENCODERS:
        _ENCODERS[digest] = Encoder(raw.value)
    return _ENCODERS[digest]


@lru_cache(maxsize=4)
def _file(path: str) -> bytes:
    return Path(path).read_bytes()


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The key and ids (array of int) of each row.

    Empty and null texts both have the empty list; the spelling of a special token inside a text is ordinary text;
    bytes that aren't UTF-8 are read as U+FFFD. Every row is one result row, repeated rows and null keys too.
    The vocabulary file (0.8 MB) is read on the driver and broadcast; there is no shuffle.
    """
    raw = _file(vocabulary)
    digest, shared = hashlib.md5(raw).hexdigest(), df.sparkSession.sparkContext.broadcast(raw)
    rows = spread(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("binary").alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(digest, shared)
        for batch in batches:
            flat, ends = [], [0]
            for value in batch.column(1):
                b = value.as_py()
                if b:
                    flat.append(np.array(own.encode(b.decode("utf-8", "replace")), np.int32))
                    ends.append(ends[-1] + len(flat[-1]))
                else:
                    ends.append(ends[-1])
            ids = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), ids)], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")
