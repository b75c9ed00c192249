"""Byte-level BPE by a monoid tree reduction.

A text is cut by a pattern and each match is encoded on its own, so matches
join by concatenation. Inside a match, halves are encoded recursively, down to
single bytes, and joined: the tokens around the seam are encoded again in a window
that grows until its outer tokens are stable next to their neighbours. A match
that is a token as a whole is that token, as in the library.

Two adjacent tokens are stable when the bytes of both encode to just these two.
A sequence whose adjacent tokens are all stable is the encoding of its bytes:
merges run by rank, then from left to right, so up to the first merge that
crosses a token's edge every token grows as it does alone, and that merge would
also cross the edge when the two tokens are encoded by themselves. The halves
and the window are encodings already, hence only the window's two edges need a
look, which makes the stop of the growth a proof and not a guess.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wordlattice.llm.common import with_columns

RANKS = "byte_bpe_50k.tiktoken"
#: Windows up to this many bytes are merged by plain scans, longer ones with a heap.
SHORT = 48
#: Distinct matches in a generation of a worker's memory; it keeps two.
MEMO = 200_000
#: Subtrees of at most this many bytes are remembered as well, LEAVES of them.
LEAF, LEAVES = 8, 200_000
#: Pairs of neighbouring tokens remembered with what they merge to.
SEAMS = 200_000
NEVER = 1 << 62
#: Neighbours that a node of the decoding tree concatenates.
FAN = 16


class ByteBPE:
    """Encoder and decoder for one rank file (``base64-bytes rank`` lines)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for data, rank in self.ranks.items():
            self.bytes_of[rank] = data
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.find = regex.compile(pattern).findall
        # when the young generation is full it becomes the old one, from which what is met again comes back
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.seam = lru_cache(SEAMS)(self._seam)
        self.stable = lru_cache(SEAMS)(self._stable)
        self.leaf = lru_cache(LEAVES)(self._halves)
        self.joins = 0

    # -- encoding -----------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, without special tokens."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        matches = self.find(text)
        for match in set(matches).difference(self.young):
            self.young[match] = self.old.get(match) or tuple(self.encode_match(match.encode()))
        return list(chain.from_iterable(map(self.young.__getitem__, matches)))

    def encode_match(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    def tree(self, data: bytes) -> list[int]:
        """The encoding of some bytes: that of either half, joined; a single byte is its own token."""
        return self.leaf(data) if len(data) <= LEAF else self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        half = len(data) // 2
        tree = self.leaf if len(data) <= 2 * LEAF - 1 else self.tree
        return self.join(tree(data[:half]), tree(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings; associative, [] is its unit."""
        if not left or not right:
            return left or right
        self.joins += 1
        window, i, j, width = self.seam(left[-1], right[0]), len(left) - 1, 1, 1
        while not ((i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j]))):
            width *= 2
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
        return [*left[:i], *window, *right[j:]]

    def _seam(self, a: int, b: int) -> list[int]:
        """The window of two tokens."""
        return self.merge(self.bytes_of[a] + self.bytes_of[b])

    def _stable(self, a: int, b: int) -> bool:
        return self.seam(a, b) == [a, b]

    def merge(self, data: bytes) -> list[int]:
        """Merges by rank, the leftmost of equal ranks first."""
        if len(data) > SHORT:
            return self._merge_long(data)
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for windows that grew large, with a heap over linked spans, in O(n log n)."""
        n, get = len(data), self.ranks.get
        end = list(range(1, n + 1))  # span that starts at i ends there; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two spans has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of token ids, concatenated up the tree."""
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return level[0] if level else b""


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One encoder a worker process."""
    return ByteBPE(path, pattern)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``token_ids`` (array of int); null texts count as empty and give []."""
    path = path or public_tokenizers.path(RANKS)

    def factory():
        c = codec(path, pattern)
        return lambda texts: [[np.array(c.encode(t or ""), np.int32) for t in texts]]

    return with_columns(df, [text_col], [T.StructField("token_ids", T.ArrayType(T.IntegerType()))], factory)


def decode(df: DataFrame, ids_col: str = "token_ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``decoded`` (binary); null ids give no bytes."""
    path = path or public_tokenizers.path(RANKS)

    def factory():
        c = codec(path, pattern)
        return lambda rows: [[c.decode(ids or []) for ids in rows]]

    return with_columns(df, [ids_col], [T.StructField("decoded", T.BinaryType())], factory)


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """``df`` with digests of each text's encoding and of what it decodes to.

    Adds ``n_tokens`` (long), ``ids_sha256`` (of the decimal ids joined by one
    space) and ``decoded_sha256``. Null and empty texts have no tokens and the
    digest of the empty string; repeated rows stay; an empty table stays empty.
    With ``keep_ids`` the ids themselves are added as ``token_ids``; otherwise they
    live only for the row at hand.
    """
    path = path or public_tokenizers.path(RANKS)

    def factory():
        c = codec(path, pattern)

        def compute(texts):
            counts, id_digests, text_digests, kept = [], [], [], []
            for text in texts:
                ids = c.encode(text or "")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.array(ids, np.int32))
            return (counts, id_digests, text_digests, kept) if keep_ids else (counts, id_digests, text_digests)

        return compute

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    return with_columns(df, [text_col], fields, factory)
