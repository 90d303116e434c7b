"""Byte-level BPE by a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import regex

#: Pre-tokens of byte_bpe_50k: fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankQueue:
    """Positions in buckets, one per merge rank; a tree of 64-bit words finds the first bucket that isn't empty."""

    def __init__(self, ranks: int):
        self.levels = [[0] * ((ranks >> 6) + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) - 1 >> 6) + 1))
        self.buckets: dict[int, list[int]] = {}

    def fill(self, found: dict[int, list[int]]) -> None:
        self.buckets = found
        for r, at in found.items():
            heapify(at)
            self._mark(r)

    def _mark(self, r: int) -> None:
        for words in self.levels:
            i, bit = r >> 6, 1 << (r & 63)
            if words[i] & bit:
                return
            words[i] |= bit
            r = i

    def push(self, r: int, pos: int) -> None:
        bucket = self.buckets.get(r)
        if bucket is None:
            self.buckets[r] = [pos]
            self._mark(r)
        else:
            heappush(bucket, pos)

    def first(self) -> int:
        """The smallest rank with a position, or -1."""
        if not self.levels[-1][0]:
            return -1
        i = 0
        for words in reversed(self.levels):
            w = words[i]
            i = i << 6 | (w & -w).bit_length() - 1
        return i

    def pop(self, r: int) -> int:
        """The leftmost position of rank r."""
        bucket = self.buckets[r]
        pos = heappop(bucket)
        if not bucket:
            del self.buckets[r]
            for words in self.levels:
                words[r >> 6] &= ~(1 << (r & 63))
                if words[r >> 6]:
                    break
                r >>= 6
        return pos


class Encoder:
    """Texts to ids. Pre-tokens seen before come from a cache of bounded size."""

    def __init__(self, vocabulary: bytes, cache: int = 1 << 18, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.cache: dict[str, list[int]] = {}
        self.cache_size = cache

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty or null text has none."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 48:
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def piece(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the lowest rank merges first, the leftmost of equal ones."""
        ranks, longest = self.ranks, self.longest
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [-1] * n  # rank of the pair that begins at a position
        found: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                now[i] = r
                found.setdefault(r, []).append(i)
        queue = self.queue
        queue.fill(found)
        while (r := queue.first()) >= 0:
            i = queue.pop(r)
            if now[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            now[j] = now[i] = -1
            if k < n:
                before[k] = i
                end = after[k]
                if end - i <= longest and (x := ranks.get(word[i:end])) is not None:
                    now[i] = x
                    queue.push(x, i)
            if (p := before[i]) >= 0:
                now[p] = -1
                if k - p <= longest and (x := ranks.get(word[p:k])) is not None:
                    now[p] = x
                    queue.push(x, p)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : after[i]]])
            i = after[i]
        return ids
