"""Byte-pair encoding with a public vocabulary: a rank queue on hierarchical bitmaps.

A pre-token's bytes form a doubly linked list of parts. Every adjacent pair that the vocabulary merges stands in the
bucket of its merge rank; a bucket holds list positions. A three-level bitmap over the ranks (64 ways each) has a bit
for each bucket that isn't empty, and finding the lowest set bit on each level gives the next rank. Entries go stale
when one of their parts has been merged meanwhile; they are skipped when their turn comes. A merge costs a constant
number of bitmap steps, so that a pre-token of a million bytes costs in proportion to its length.

Within a rank the leftmost pair comes first, as the rule of the vocabulary wants it: a bucket is a heap of positions.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import regex

#: The splitting pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000


class RankQueue:
    """Pairs by merge rank; `pop` gives the lowest rank's leftmost position."""

    __slots__ = ("buckets", "low", "middle", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        if bucket := self.buckets.get(rank):
            heapq.heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.middle[b] = self.middle.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.middle[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        at = heapq.heappop(bucket)
        if not bucket:
            self.low[a] = left = word & (word - 1)
            if not left:
                self.middle[b] = left = self.middle[b] & ~(1 << (a & 63))
                if not left:
                    self.top &= ~(1 << b)
        return rank, at


class Encoder:
    """ids of texts by a vocabulary of byte strings and ranks, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts there; 0 for a start that was merged away
        before = list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            j = end[i]
            if not j or j >= n or ranks.get(piece[i : (k := end[j])]) != rank:
                continue  # stale: one of its parts was merged meanwhile
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    queue.push(r, i)
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:k])) is not None:
                queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or a null one. Lone surrogates are read as U+FFFD."""
        if not text:
            return []
        cache, ids = self.cache, []
        for piece in self.find(text):
            known = cache.get(piece)
            if known is None:
                known = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = known
            ids += known
        return ids


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    """One encoder a worker process and vocabulary (base64 token and rank a line)."""
    return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())})
