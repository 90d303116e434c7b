"""numpy kernels of the passage search: windows of word ids, TF-IDF sketches, alignment checks. Nothing here uses Spark."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: Words a window holds and the step between windows: every run of RUN words lies whole in one of them.
RUN, LENGTH, STEP = 13, 20, 8
PAD = -2


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits after NFKC and lower-casing; an underscore separates."""
    if not text:
        return []
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def windows(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of many texts (rows of LENGTH ids, PAD behind the end) and the text each belongs to.

    Texts of fewer than ``least`` words have none; windows begin every ``step`` words as long as ``least`` are left.
    """
    n = np.where(lengths >= least, (lengths - least) // step + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = (nth * step)[:, None] + np.arange(LENGTH)
    inside = at < lengths[owner][:, None]
    index = np.where(inside, starts[owner][:, None] + at, 0)
    return (np.where(inside, flat[index], PAD) if len(flat) else np.empty((0, LENGTH), np.int32)).astype(np.int32), owner


def add_gram(rows: np.ndarray, weighted: np.ndarray, idf: np.ndarray, total: np.ndarray) -> float:
    """Adds the windows' share of (Gram matrix x sketch) to ``total``; returns the sum of their squared weights.

    ``weighted`` is the sketch with idf in it and zeros in its last two rows (-2, -1). A window's product with it is a sum
    of rows; that sum goes to each of the window's words, gathered by word.
    """
    of_window = np.zeros((len(rows), weighted.shape[1]), weighted.dtype)
    for j in range(rows.shape[1]):
        of_window += weighted[rows[:, j]]
    flat = rows.ravel()
    at = np.flatnonzero(flat >= 0)
    at = at[np.argsort(flat[at], kind="stable")]
    ids = flat[at]
    if not len(ids):
        return 0.0
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    terms = ids[starts]
    total[terms] += idf[terms, None] * np.add.reduceat(of_window[at // rows.shape[1]], starts, axis=0)
    return float((idf[ids] ** 2).sum())


def project(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of windows in the latent space; ``basis`` has idf in it and zeros in its last two rows (-2, -1)."""
    out = np.zeros((len(rows), basis.shape[1]), np.float32)
    for j in range(rows.shape[1]):
        out += basis[rows[:, j]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def marks(rows: np.ndarray, size: int) -> np.ndarray:
    """The bit (0 to 63) of each word of windows that an item can hold, 64 for every other place."""
    return np.where((rows >= 0) & (rows < size), rows % 61, 64).astype(np.uint8)


def signatures(bits: np.ndarray) -> np.ndarray:
    """The bits of each window's words in one number."""
    return np.bitwise_or.reduce(np.where(bits < 64, np.uint64(1) << (bits & 63).astype(np.uint64), np.uint64(0)), axis=1) if len(bits) else np.empty(0, np.uint64)


def promising(bits: np.ndarray, x: np.ndarray, signature: np.ndarray, least: int) -> np.ndarray:
    """The pairs (window x of ``bits`` and a signature) in which at least ``least`` places of x can stand in the other.

    A place whose bit isn't in the signature has no equal word there, so nothing that ``sharing`` keeps is lost.
    """
    n = np.zeros(len(x), np.uint8)
    wide = np.where(bits < 64, bits, 63).astype(np.uint64)  # bit 63 is no word's
    for j in range(bits.shape[1]):
        n += ((signature >> wide[x, j]) & np.uint64(1)).astype(np.uint8)
    return np.flatnonzero(n >= least)


def sharing(a: np.ndarray, b: np.ndarray, least: int, chunk: int = 4_096) -> np.ndarray:
    """The pairs of windows with at least ``least`` places of a whose word also stands in b: all that can pass the checks."""
    small = np.int16 if max(a.max(initial=0), b.max(initial=0)) < 32_000 else np.int32
    out = []
    for lo in range(0, len(a), chunk):
        x, y = a[lo : lo + chunk].astype(small), b[lo : lo + chunk].astype(small)
        x[x < 0] = -9  # matches neither an unknown word nor the padding
        found = x == y[:, :1]
        for j in range(1, LENGTH):
            found |= x == y[:, j : j + 1]
        out.append(np.flatnonzero(found.sum(1) >= least) + lo)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence and longest common run of each pair of windows (ids below 0 match nothing)."""
    same = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
    octets = np.packbits(same, axis=2, bitorder="little").astype(np.uint32)
    bits = octets[:, :, 0] | octets[:, :, 1] << np.uint32(8) | octets[:, :, 2] << np.uint32(16)
    full = np.uint32((1 << LENGTH) - 1)
    v = np.full(len(a), full, np.uint64)
    for i in range(LENGTH):
        u = v & bits[:, i]
        v = ((v + u) | (v - u)) & np.uint64(full)
    subsequence = LENGTH - np.bitwise_count(v).astype(np.int32)
    run, most = np.zeros((len(a), LENGTH + 1), np.int8), np.zeros(len(a), np.int8)
    for i in range(LENGTH):
        run[:, 1:] = (run[:, :-1] + 1) * same[:, i]
        np.maximum(most, run.max(1), out=most)
    return subsequence, most.astype(np.int32)


def answered(a: np.ndarray, b: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Whether every telling word (numbers and names with digits) of window b also stands in window a."""
    same = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(1)
    return (same | ~telling[b]).all(1)


class Index:
    """The word pairs (single words for few words in common) of the items of a block, by which every passage is met.

    If ``least`` of LENGTH words stand in the same order in two windows, at most 2 * (LENGTH - least) of the least - 1
    steps from one common word to the next skip a word, so the other steps are word pairs that both windows hold, on
    diagonals that differ by at most LENGTH - least from that of the windows. A run of RUN words is RUN - 1 pairs in a
    row on one diagonal.
    """

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, size: int, least: int):
        self.flat, self.lengths, self.starts, self.size, self.least = flat, lengths, np.cumsum(lengths) - lengths, size, least
        self.gram = 2 if 3 * least - 2 * LENGTH - 1 >= 1 else 1
        self.needed = 3 * least - 2 * LENGTH - 1 if self.gram == 2 else least
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(flat)) - self.starts[owner]
        self.longest = max(2 * LENGTH, int(lengths.max(initial=0)))
        code, inside = self.codes(flat, place, lengths[owner])
        code, owner, place = code[inside], owner[inside], place[inside]
        order = np.argsort(code, kind="stable")
        self.item, self.place = owner[order], place[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)

    def codes(self, flat: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = flat.astype(np.int64)
        if self.gram == 1:
            return here, (here >= 0) & (here < self.size)
        after = np.append(here[1:], -1)
        return here * self.size + after, (here >= 0) & (here < self.size) & (after >= 0) & (after < self.size) & (place + 1 < length)

    def hits(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, place in the text and place in the item of each gram in common, of the pairs with enough of them."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        code, inside = self.codes(flat[starts[owner] + place], place, lengths[owner])
        at = np.minimum(np.searchsorted(self.code, code), max(len(self.code) - 1, 0))
        hit = np.flatnonzero(crowded(inside & (self.code[at] == code), LENGTH - self.gram + 1, min(self.needed, RUN - self.gram + 1))) if len(self.code) else np.empty(0, np.int64)
        n = self.count[at[hit]]
        which = np.repeat(self.first[at[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit = np.repeat(hit, n)
        text, item = owner[hit], self.item[which]
        pair = text * len(self.lengths) + item
        enough = np.bincount(pair, minlength=1)[pair] >= min(self.needed, RUN - self.gram + 1)
        hit, which = hit[enough], which[enough]
        return owner[hit], self.item[which], place[hit], self.place[which]

    def verbatim(self, hits: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Text, item, both places of the first word and the number of words of each common run of RUN words or more."""
        text, item, p, q = hits
        if not len(p):
            return text, item, p, q, p
        # pair, diagonal and place in one number: in order, a run counts up by one
        place, shift = int(p.max()) + 2, int(p.max()) + self.longest + 1
        if (int(text.max()) + 1) * len(self.lengths) * shift * place < 1 << 62:
            code = ((text * len(self.lengths) + item) * shift + (p - q + self.longest)) * place + p
            order = np.argsort(code, kind="stable")
            new = np.append(True, np.diff(code[order]) != 1)
        else:
            order = np.lexsort((p, q - p, item, text))
            same = [np.diff(x[order]) for x in (text, item, p, q)]
            new = np.append(True, (same[0] != 0) | (same[1] != 0) | (same[2] != 1) | (same[3] != 1))
        first = np.flatnonzero(new)
        words = np.diff(np.append(first, len(p))) + self.gram - 1
        at, words = order[first[words >= RUN]], words[words >= RUN]
        return text[at], item[at], p[at], q[at], words

    def near(self, hits: tuple[np.ndarray, ...], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and the places in both of all windows that can have ``least`` words in the same order."""
        text, item, p, q = hits
        need, reach, span = self.needed, LENGTH - self.least, LENGTH - self.gram
        group = text * len(self.lengths) + item
        order = np.lexsort((p, group))
        dense = np.zeros(len(p) + 1, np.int64)
        at = dense_runs(group[order], p[order], need, span)
        np.add.at(dense, at, 1)
        np.add.at(dense, at + need, -1)
        keep = order[np.cumsum(dense[:-1]) > 0]
        shift = np.repeat(q[keep] - p[keep], 2 * reach + 1) + np.tile(np.arange(-reach, reach + 1), len(keep))
        keep = np.repeat(keep, 2 * reach + 1)
        order = np.lexsort((p[keep], shift, group[keep]))
        keep, shift = keep[order], shift[order]
        new = np.ones(len(keep), bool)
        new[1:] = (group[keep][1:] != group[keep][:-1]) | (shift[1:] != shift[:-1])
        line = np.cumsum(new)
        at = dense_runs(line, p[keep], need, span)
        lo, hi, which = p[keep[at + need - 1]] - span, p[keep[at]], keep[at]
        same = np.zeros(len(at), bool)
        same[1:] = line[at[1:]] == line[at[:-1]]
        lo[1:] = np.where(same[1:], np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
        n = np.maximum(hi - lo + 1, 0)
        i = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        j = i + np.repeat(shift[at], n)
        text, item = text[np.repeat(which, n)], item[np.repeat(which, n)]
        real = (i >= 0) & (i <= np.maximum(length[text] - LENGTH, 0)) & (j >= 0) & (j <= self.lengths[item] - self.least)
        return text[real], item[real], i[real], j[real]

    def item_windows(self, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        return window_at(self.flat, self.starts[item], self.lengths[item], at)


def crowded(hit: np.ndarray, width: int, needed: int) -> np.ndarray:
    """The hits that lie with others, ``needed`` in all, inside ``width`` places."""
    n, at = len(hit), np.arange(len(hit))
    total = np.append(0, np.cumsum(hit))
    begins = np.append(0, np.cumsum(total[np.minimum(at + width, n)] - total[:-1] >= needed))
    return hit & (begins[at + 1] > begins[np.maximum(at - width + 1, 0)])


def dense_runs(group: np.ndarray, place: np.ndarray, needed: int, span: int) -> np.ndarray:
    """Where ``needed`` rows of one group (sorted by place) begin that lie at most ``span`` apart."""
    n = len(group) - needed + 1
    return np.flatnonzero((group[:n] == group[needed - 1 :]) & (place[needed - 1 :] - place[:n] <= span)) if n > 0 else np.empty(0, np.int64)


def window_at(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows that begin at the word ``at`` of their text."""
    place = at[:, None] + np.arange(LENGTH)
    inside = place < lengths[:, None]
    return np.where(inside, flat[np.where(inside, starts[:, None] + place, 0)], PAD).astype(np.int32)


def pieces(starts: np.ndarray, lengths: np.ndarray, most: int, whole: int = 2 * LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of pieces of at most ``most`` words, and the text of each; any ``whole`` words lie in one."""
    step = most - whole
    n = np.maximum(1, -(-(lengths - whole) // step))
    owner = np.repeat(np.arange(len(lengths)), n)
    lo = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * step
    return starts[owner] + lo, np.minimum(lengths[owner] - lo, most), owner
