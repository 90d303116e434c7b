"""Held-out items whose passages stand in corpus texts, by latent semantic retrieval.

1. Texts become arrays of word ids, a table in the shared folder: a word of the block's items has its own id, every other
   word of the corpus one of 2**12 hashed ones, so that passages weigh all their words.
2. Document frequencies over all texts; TF-IDF passages of 20 words.
3. A randomised SVD: two passes over all passages apply the Gram matrix to a random sketch, summed by blocks of terms in
   the cluster, in two steps; the driver sees only matrices of vocabulary x rank. The items' own passages have equal weight.
4. One pass over all texts: windows of 20 words every 8 go into the latent space and meet every item window by cosine.
5. Word pairs that a text shares with an item give the candidates that no cosine bounds: every run of 13 words, and windows of 20 words at every place of both that can share 16.
6. Candidates pass a longest-common-subsequence check, then the check of consecutive words (verbatim), or of the
   telling words (paraphrase).

So a passage is found wherever it begins, and not only where windows of both sides meet. No cosine is low enough for all runs of 13, since rarer words beside a run of common ones outweigh it. So step 5 proposes
every run, and the threshold loses none. Texts are never cut, and no number of candidates is capped: they're checked
where they arise and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from arborix.llm import passages as P
from arborix.llm.spread import spread
from arborix.session import Scratch

#: Words of items in a block. A block's vocabulary, windows and basis are broadcast: at most 400,000 words x 74 floats, 120 MB.
#: A block closes with the item that fills it; an item of its own larger than that is a block of its own.
BLOCK = 400_000
RANK, OVERSAMPLE, THRESHOLD, PARAPHRASE = 64, 10, 0.45, 16
ROWS, PAIRS, TERMS = 2_048, 20_000, 64
#: Ids of the words that no item holds, by hash, and the first sums that the parts of a block of terms go into.
HASHED, SUMS = 1 << 12, 16
#: Words whose ids a task remembers at once.
MOST_WORDS = 1_000_000
#: Words of a piece of a text, and of the pieces that meet the items at once.
PIECE, PIECES = 20_000, 40_000


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, starts and lengths of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def _word_ids(texts: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = len(known)

        class Ids(dict):  # one lookup a word; a new word of the corpus is hashed once a task
            def __missing__(self, w: str) -> int:
                self[w] = i = size + zlib.crc32(w.encode("utf-8", "replace")) % HASHED
                return i

        ids_of = Ids(known)
        for batch in batches:
            out, ends = [], [0]
            for b in batch.column(1):
                raw = b.as_py()
                if raw:
                    out += [ids_of[w] for w in P.words(raw.decode("utf-8", "replace"))]
                if len(ids_of) > MOST_WORDS:
                    ids_of = Ids(known)
                ends.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))], ["key", "ids"])

    return texts.mapInArrow(run, f"key {texts.schema[0].dataType.simpleString()}, ids array<int>")


def _frequencies(ids: DataFrame, size: int) -> np.ndarray:
    """Texts that each word of the vocabulary stands in; the last place counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            flat, _, lengths = _lists(batch.column(0))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            cell = np.unique((owner * size + flat)[flat >= 0])
            total[:size] += np.bincount(cell % size, minlength=size)
            total[size] += len(lengths)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    found = ids.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _with_idf(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The matrix with idf in its rows, and zero rows for the ids -2 and -1."""
    out = np.zeros((len(idf) + 2, matrix.shape[1]), np.float32)
    out[: len(idf)] = matrix * idf[:, None]
    return out


def _gram(ids: DataFrame, idf: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, float]:
    """The Gram matrix of all passages times the sketch, and the sum of the squared weights of all their words."""
    shared = ids.sparkSession.sparkContext.broadcast((idf, _with_idf(sketch, idf)))
    size, width = sketch.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weighted = shared.value
        total, energy = np.zeros((size, width), np.float64), 0.0
        for batch in batches:
            rows, _ = P.windows(*_lists(batch.column(0)), P.LENGTH, 1)
            rows = rows[(rows >= 0).any(1)]
            for lo in range(0, len(rows), ROWS):
                energy += P.add_gram(rows[lo : lo + ROWS], weighted, idf, total)
        touched = [lo for lo in range(0, size, TERMS) if total[lo : lo + TERMS].any()]
        data = [*(total[lo : lo + TERMS].tobytes() for lo in touched), np.array([energy]).tobytes()]
        part = TaskContext.get().partitionId() % SUMS
        yield pa.RecordBatch.from_arrays([pa.array([*touched, -1], pa.int32()), pa.array([part] * len(data), pa.int32()), pa.array(data, pa.binary())], ["block", "part", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["data"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [0], "data": [total.tobytes()]})

    fields = "block int, part int, data binary"
    sums = ids.select("ids").mapInArrow(run, fields).groupBy("block", "part").applyInPandas(add, fields)
    found = sums.groupBy("block").applyInPandas(add, fields).toPandas()
    total, energy = np.zeros((size, width)), 0.0
    for lo, x in zip(found["block"], found["data"]):
        if lo < 0:
            energy = float(np.frombuffer(x)[0])
        else:
            total[lo : lo + TERMS] = np.frombuffer(x).reshape(-1, width)
    return total, energy


def _basis(ids: DataFrame, idf: np.ndarray, own: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the corpus passages and, at equal energy, the items' passages."""
    size = len(idf)
    width = min(size, rank + OVERSAMPLE)

    def apply(q: np.ndarray) -> np.ndarray:
        z, energy = _gram(ids, idf, q)
        mine = np.zeros_like(z)
        weight = P.add_gram(own, _with_idf(q, idf), idf, mine)
        return z / max(energy, 1e-9) + mine / max(weight, 1e-9)

    q, _ = np.linalg.qr(apply(np.random.default_rng(seed).standard_normal((size, width))))
    t = q.T @ apply(q)
    values, vectors = np.linalg.eigh((t + t.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def _parts(columns: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    for lo in range(0, len(columns[0]), PAIRS):
        yield tuple(v[lo : lo + PAIRS] for v in columns)


def _search(ids: DataFrame, basis: np.ndarray, own: np.ndarray, item: np.ndarray, telling: np.ndarray, index: P.Index, threshold: float, paraphrase: int, reworded: bool) -> DataFrame:
    shared = ids.sparkSession.sparkContext.broadcast((basis, own, item, telling, index, P.project(own, basis)))
    key = ids.schema["key"].dataType.simpleString()

    def check(a: np.ndarray, b: np.ndarray, text: np.ndarray, of: np.ndarray, telling: np.ndarray) -> np.ndarray:
        both = P.sharing(a, b, min(P.RUN, paraphrase))
        a, b, text, of = a[both], b[both], text[both], of[both]
        subsequence, run = P.longest(a, b)
        para = (subsequence >= paraphrase) & reworded
        para[para] = P.answered(a[para], b[para], telling)
        good = (run >= P.RUN) | para
        return np.stack([text[good], of[good], run[good], subsequence[good]])

    def latent_pairs(lists: tuple[np.ndarray, ...], basis, own, item, telling, latent, index) -> Iterator[np.ndarray]:
        rows, owner = P.windows(*lists, P.STEP, P.RUN)
        keep = ((rows >= 0) & (rows < index.size)).sum(1) >= P.RUN
        rows, owner = rows[keep], owner[keep]
        mine, theirs = P.marks(rows, index.size), P.signatures(P.marks(own, index.size))
        least = min(P.RUN, paraphrase)
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            near, which = np.divmod(np.flatnonzero(P.project(part, basis) @ latent.T >= threshold), len(own))
            for at in range(0, len(near), PAIRS):
                x, y = near[at : at + PAIRS], which[at : at + PAIRS]
                both = P.promising(mine[lo : lo + ROWS], x, theirs[y], least)
                x, y = x[both], y[both]
                yield check(part[x], own[y], owner[lo + x], item[y], telling)

    def exact_pairs(lists: tuple[np.ndarray, ...], index: P.Index, telling: np.ndarray) -> Iterator[np.ndarray]:
        flat, starts, lengths = lists
        starts, lengths, owner = P.pieces(starts, lengths, max(PIECE, 2 * index.longest), index.longest)
        group = np.cumsum(lengths) // PIECES
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            first, long = starts[mine], lengths[mine]
            hits = index.hits(flat, first, long)
            for t, o, x, y, n in _parts(index.verbatim(hits)):
                subsequence, _ = P.longest(P.window_at(flat, first[t], long[t], x), index.item_windows(o, y))
                yield np.stack([owner[mine[t]], o, n, subsequence])
            for t, o, x, y in _parts(index.near(hits, long)) if reworded else ():
                yield check(P.window_at(flat, first[t], long[t], x), index.item_windows(o, y), owner[mine[t]], o, telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, own, item, telling, index, latent = shared.value
        for batch in batches:
            lists = _lists(batch.column(1))
            found = [*latent_pairs(lists, basis, own, item, telling, latent, index), *exact_pairs(lists, index, telling)]
            if found and (pairs := np.concatenate(found, 1)).shape[1]:
                best = pd.DataFrame({"o": pairs[0], "i": pairs[1], "r": pairs[2], "s": pairs[3]}).groupby(["o", "i"], as_index=False).max()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(best["o"].to_numpy())), *[pa.array(best[c].to_numpy(), t) for c, t in (("i", pa.int32()), ("r", pa.int32()), ("s", pa.int32()))]],
                    ["key", "item", "longest_run", "longest_subsequence"],
                )

    return ids.mapInArrow(run, f"key {key}, item int, longest_run int, longest_subsequence int")


def leaks(
    texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, rank: int = RANK, threshold: float = THRESHOLD, paraphrase: int = PARAPHRASE, seed: int = 7, block: int = BLOCK, reworded: bool = True
) -> DataFrame:
    """The key, item_key, kind, longest_run and longest_subsequence of each text with a passage of an item.

    kind is `verbatim` with 13 or more consecutive words in common, otherwise `paraphrase`: of 20 words 16 (the
    parameter) in the same order, and every word with a digit of the item's window. longest_run is
    the whole run of a verbatim pair, however long (of a paraphrase the longest inside its windows). longest_subsequence
    is that of windows of 20 words, at any place of both; of a verbatim pair with fewer than 16 words in the same order
    that of the windows that were met, at least 13.

    Without ``reworded`` only verbatim passages are sought, by the same search without the windows that can only be
    paraphrases.

    Null and empty texts and items, and those with fewer than 13 words, are in no pair. Repeated rows give one row.
    The items are a stated query set, taken in blocks; a block is broadcast, the texts are never.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "leaks")
    rows = spread(texts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("t")))
    wanted = items.where(F.col(f"`{item_key}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_key}`").alias("k"), F.col(f"`{item_text}`").alias("t"))
    item_type = wanted.schema["k"].dataType
    out = spark.createDataFrame([], f"`{key}` {rows.schema[0].dataType.simpleString()}, `{item_key}` {item_type.simpleString()}, kind string, longest_run int, longest_subsequence int")
    part: list = []
    n = held = 0
    for last, row in _with_end(wanted.toLocalIterator()):
        w = P.words(row.t) if row is not None else []
        if part and (last or held + len(w) > block):
            out = out.unionByName(_block(rows, scratch, n, part, key, item_key, item_type, rank, threshold, paraphrase, seed, reworded))
            part, n, held = [], n + 1, 0
        if len(w) >= P.RUN:
            part.append((row.k, w))
            held += len(w)
    return out.distinct() if n > 1 else out


def _with_end(rows: Iterator) -> Iterator:
    for r in rows:
        yield False, r
    yield True, None


def _block(rows, scratch, n, part, key, item_key, item_type, rank, threshold, paraphrase, seed, reworded) -> DataFrame:
    names = sorted({w for _, ws in part for w in ws})
    vocabulary = {w: i for i, w in enumerate(names)}
    size = len(names)
    every = size + HASHED
    flat = np.array([vocabulary[w] for _, ws in part for w in ws], np.int32)
    lengths = np.array([len(ws) for _, ws in part], np.int64)
    own, item = P.windows(flat, np.cumsum(lengths) - lengths, lengths, P.STEP, P.RUN)
    ids = scratch.write(_word_ids(rows, vocabulary), f"ids{n}")
    seen = _frequencies(ids, every)
    idf = np.log((seen[every] + 1) / (seen[:every] + 1)) + 1
    basis = _basis(ids, idf, own, rank, seed)
    weighted = _with_idf(basis, idf)
    telling = np.zeros(size + 2, bool)
    telling[:size] = [any(c.isdigit() for c in w) for w in names]
    own = np.where(own >= 0, own, P.PAD).astype(np.int32)
    found = _search(ids, weighted, own, item.astype(np.int32), telling, P.Index(flat, lengths, size, paraphrase), threshold, paraphrase, reworded)
    keys = rows.sparkSession.createDataFrame([(i, k) for i, (k, _) in enumerate(part)], f"item int, k {item_type.simpleString()}")
    kind = F.when(F.col("longest_run") >= P.RUN, "verbatim").otherwise("paraphrase").alias("kind")
    return found.join(F.broadcast(keys), "item").select(F.col("key").alias(key), F.col("k").alias(item_key), kind, "longest_run", "longest_subsequence").distinct()
