"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z only) and cut into words of ASCII letters, digits and
all non-ASCII characters. Every run of WINDOW item words is a window; a shorter
item is one window of its own length. A document's words are turned into
checksums, hashes of all its windows are looked up in the hash set, and each hit
is verified against the window's words before it counts.

The benchmark is sent to the executors in blocks of at most BLOCK_BYTES of text
(its size is measured first); documents pass the blocks one after the other,
so a benchmark of any size is scanned with bounded memory.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlattice.llm.common import stored, unused, with_columns

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: In filter_spans, a document loses its hit words, and goes as a whole beyond this share of hit words.
WHOLE = 0.5

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8; none for null."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The windows of some benchmark items, ready to be looked up, in a few flat arrays.

    All words stand in one byte string between single blanks, so a window is a
    slice of it and a hit is verified by comparing bytes. Hashes of windows are
    sorted; a bit filter of sixteen bits or more a window comes before them. Text
    of n bytes takes some 4n bytes at six bytes a word, at most 13n.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = [(item, found) for item, text in items if (found := words(text))]
        self.items = [item for item, _ in texts]
        self.text = b" ".join(b" ".join(found) for _, found in texts)
        lengths = np.fromiter((len(w) + 1 for _, found in texts for w in found), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64 if len(self.text) >> 31 else np.int32)
        codes = np.fromiter((zlib.crc32(w) for _, found in texts for w in found), np.uint64)
        sizes = np.array([len(found) for _, found in texts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.found = {}
        for size in sorted({min(window, n) for n in sizes.tolist()}):
            mine = sizes >= window if size == window else sizes == size
            counts = (sizes - size + 1)[mine]
            at = np.repeat(self.first[mine] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            self.found[size] = self._index(size, at, codes)

    def _index(self, size: int, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(hashes, places, filter, bits) of the windows that begin at the words ``at``, each once an item."""
        hashes = self._hash([codes[at + k] for k in range(size)])
        order = np.argsort(hashes, kind="stable")  # places of equal hashes stay in order, so by item
        hashes, at = hashes[order], at[order]
        item = np.searchsorted(self.first, at, "right")
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])) + 1
        twice = [k for k in again.tolist() if self._window(at[k], size) == self._window(at[k - 1], size)]
        hashes, at = np.delete(hashes, twice), np.delete(at, twice)
        bits = max(10, (16 * len(at)).bit_length())
        seen = np.zeros(1 << bits - 3, np.uint8)
        place = hashes >> np.uint64(64 - bits)
        np.bitwise_or.at(seen, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return hashes, at.astype(self.starts.dtype), seen, bits

    def _window(self, at: int, size: int) -> bytes:
        return self.text[self.starts[at] : self.starts[at + size] - 1]

    @staticmethod
    def _hash(columns) -> np.ndarray:
        """Hashes of windows, given as one array for each place."""
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Which words lie in an occurrence of a window, and the items of these windows."""
        hit, items = np.zeros(len(tokens), bool), set()
        codes = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
        for size, (hashes, places, seen, bits) in self.found.items():
            n = len(codes) - size + 1
            if n <= 0:
                continue
            mine = self._hash([codes[k : k + n] for k in range(size)])
            place = mine >> np.uint64(64 - bits)
            maybe = np.flatnonzero((seen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
            low, high = np.searchsorted(hashes, mine[maybe], "left"), np.searchsorted(hashes, mine[maybe], "right")
            verified: dict[bytes, bool] = {}
            for i, a, b in zip(maybe.tolist(), low.tolist(), high.tolist(), strict=True):
                if a == b:
                    continue
                text = b" ".join(tokens[i : i + size])
                if text not in verified:
                    same = [at for at in places[a:b].tolist() if self._window(at, size) == text]
                    items.update(self.items[k] for k in (np.searchsorted(self.first, same, "right") - 1).tolist())
                    verified[text] = bool(same)
                if verified[text]:
                    hit[i : i + size] = True
        return hit, items


def block_count(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> int:
    """How many blocks the benchmark is sent in."""
    text, item = F.octet_length(text_col), F.octet_length(F.col(item_col).cast("string"))
    size = benchmark.agg(F.coalesce(F.sum(F.coalesce(text, F.lit(0)) + F.coalesce(item, F.lit(0)) + 64), F.lit(0))).first()[0]
    return -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW):
    """Yields Windows over parts of the benchmark that hold about BLOCK_BYTES of text or less."""
    count = block_count(benchmark, item_col, text_col)
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for k in range(count):
        part = b if count == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield Windows([(r.item, r.text) for r in part.collect()], window)


def _scanned(df: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, bench_text_col: str, window: int, into: tuple[str, str]) -> DataFrame:
    """``df`` with two columns named by ``into``: a byte for each word, 1 if hit, and the items (sorted strings; null for those without an id)."""
    fields = [T.StructField(into[0], T.BinaryType()), T.StructField(into[1], T.ArrayType(T.StringType()))]
    out, first, shared = df, True, None
    for block in blocks(benchmark, item_col, bench_text_col, window):
        if not first:
            # the table holds what the last block found, so that block isn't needed any more
            out = stored(out)
            shared.unpersist()
        shared = df.sparkSession.sparkContext.broadcast(block)

        def factory(shared=shared, first=first):
            scan = shared.value.scan

            def compute(texts, hits=None, items=None):
                flags, names = [], []
                for k, text in enumerate(texts):
                    hit, found = scan(words(text))
                    if not first:
                        hit |= np.frombuffer(hits[k], bool)
                        found = found.union(items[k])
                    flags.append(hit.tobytes())
                    names.append(sorted(found, key=lambda x: (x is None, x)))
                return flags, names

            return compute

        out = with_columns(out, [text_col] if first else [text_col, *into], fields, factory)
        first = False
    return out


def report(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with n_words, n_hit, n_items (long), items_sha256 and contaminated.

    A null or empty text has no words and no hits. An item without words, or an
    empty benchmark, hits nothing. An item without an id hits words but is not
    listed. Repeated items count once by id; repeated documents stay. Columns named
    like the five are replaced, all others pass.
    """
    passing = unused(df, "_hits"), unused(df, "_items")

    def factory():
        def compute(hits, items):
            out = [[], [], [], [], []]
            for h, names in zip(hits, items, strict=True):
                names = [x for x in names if x is not None]
                n = h.count(1)
                row = len(h), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return compute

    found = _scanned(df, benchmark, text_col, item_col, bench_text_col, window, passing)
    fields = [*(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    return with_columns(found, passing, fields, factory).drop(*passing)


def _cut(text: str, hit: np.ndarray) -> str:
    """``text`` without its hit words and what stands between two of them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, done, i = [], 0, 0
    while i < len(spans):
        if hit[i]:
            j = i
            while j + 1 < len(spans) and hit[j + 1]:
                j += 1
            out.append(text[done : spans[i][0]])
            done = spans[j][1]
            i = j
        i += 1
    return "".join(out) + text[done:]


def filter_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, whole: float = WHOLE) -> DataFrame:
    """``df`` without benchmark passages: hit words are cut out of texts, and documents of which more than ``whole`` was hit go.

    What a cut leaves is scanned again until nothing is hit, as words on its two
    sides may form another window. Clean texts pass unchanged, nulls included. A
    benchmark of one block is scanned in one pass; with more blocks, each round
    passes all of them and ends in a stored table. All columns but the text pass.
    """
    order, gone = df.columns, unused(df, "_gone")
    if block_count(benchmark, item_col, bench_text_col) > 1:
        return _filter_by_rounds(df, benchmark, text_col, item_col, bench_text_col, window, whole).select(*order)
    (block,) = blocks(benchmark, item_col, bench_text_col, window)
    shared = df.sparkSession.sparkContext.broadcast(block)

    def clean(text):
        total, lost = None, 0
        while True:
            tokens = words(text)
            hit, _ = shared.value.scan(tokens)
            total, lost = len(tokens) if total is None else total, lost + int(hit.sum())
            if not hit.any():
                return text, False
            if lost > whole * total:
                return text, True
            text = _cut(text, hit)

    def factory():
        def compute(texts):
            done = [clean(t) for t in texts]
            return [t for t, _ in done], [lost for _, lost in done]

        return compute

    fields = [T.StructField(text_col, T.StringType()), T.StructField(gone, T.BooleanType())]
    return with_columns(df, [text_col], fields, factory).where(~F.col(gone)).select(*order)


def _filter_by_rounds(df, benchmark, text_col, item_col, bench_text_col, window, whole) -> DataFrame:
    hits_, items_, total_, lost_, gone_, again_ = (unused(df, f"_{x}") for x in ("hits", "items", "total", "lost", "gone", "again"))

    def factory():
        def compute(texts, hits, totals, losses):
            out = [[], [], [], [], []]
            for text, h, total, lost in zip(texts, hits, totals, losses, strict=True):
                hit = np.frombuffer(h, bool)
                total, lost = len(hit) if total is None else total, lost + int(hit.sum())
                gone = hit.any() and lost > whole * total
                row = _cut(text, hit) if hit.any() and not gone else text, total, lost, bool(gone), bool(hit.any() and not gone)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return compute

    fields = [T.StructField(text_col, T.StringType()), *(T.StructField(c, T.LongType()) for c in (total_, lost_)), *(T.StructField(c, T.BooleanType()) for c in (gone_, again_))]
    state = df.withColumn(total_, F.lit(None).cast("long")).withColumn(lost_, F.lit(0).cast("long"))
    while True:
        found = _scanned(state, benchmark, text_col, item_col, bench_text_col, window, (hits_, items_))
        done = with_columns(found, [text_col, hits_, total_, lost_], fields, factory)
        state = stored(done.where(~F.col(gone_)).drop(hits_, items_, gone_))
        if state.where(F.col(again_)).isEmpty():
            return state
        state = state.drop(again_)
