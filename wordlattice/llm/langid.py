"""Language ID by hyperdimensional profiles.

Each code point has a pseudo-random vector of +1 and -1. A letter n-gram binds
the vectors of its letters, each rotated by its place, by multiplication. A text
bundles (adds) the vectors of its n-grams, a language those of all its training
texts; a text gets the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlattice.llm.common import bounded_batches, slices, with_columns

N = 3
DIMENSIONS = 512
#: n-gram vectors remembered by a worker (float32), cleared when full.
ROWS = 12_000
#: n-grams that a training task counts before it bundles them.
PENDING = 100_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters (three 21-bit code points) and their counts.

    Everything between letters counts as one blank, and a text begins and ends with one.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a run of letters stays
    points = np.concatenate(([32], np.where(letter, points, 32)[keep], [32])).astype(np.int64)
    if points[-2] == 32:
        points = points[:-1]
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.unique(codes, return_counts=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Space:
    """Vectors of n-grams, made when first needed."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((ROWS, dimensions), np.float32)
        self.letter = lru_cache(4096)(self._letter)

    def _letter(self, point: int) -> np.ndarray:
        """The fixed +1/-1 vector of a code point."""
        with np.errstate(over="ignore"):
            seeds = np.arange(1, self.dimensions // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(point + 1) * np.uint64(0xD1B54A32D192ED03)
            bits = np.unpackbits(_mixed(seeds).view(np.uint8))
        return bits.astype(np.float32) * 2 - 1

    def _bound(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, each as often as it occurs."""
        total = np.zeros(self.dimensions, np.float64)
        for i in range(0, len(codes), ROWS):
            part, weight = codes[i : i + ROWS].tolist(), counts[i : i + ROWS].astype(np.float32)
            missing = [c for c in part if c not in self.row]
            if len(self.row) + len(missing) > ROWS:
                self.row.clear()
                missing = part
            for c in missing:
                k = self.row[c] = len(self.row)
                self.vectors[k] = self._bound(c)
            total += weight @ self.vectors[[self.row[c] for c in part]]
        return total


@lru_cache(1)
def space(dimensions: int) -> Space:
    """One space a worker process."""
    return Space(dimensions)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows with a text and a language.

    Tasks count n-grams by language, bundle them and pass on one vector for each
    language; the driver gets as many vectors as there are languages.
    """
    bounded_batches(df.sparkSession)
    schema = "lang string, place int, weight double"

    def run(batches):
        s, counts = space(dimensions), {}
        sums: dict[str, np.ndarray] = {}

        def bundle():
            for lang, table in counts.items():
                v = s.bundle(np.fromiter(table, np.int64, len(table)), np.fromiter(table.values(), np.int64, len(table)))
                sums[lang] = sums[lang] + v if lang in sums else v
            counts.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = counts.setdefault(lang, {})
                codes, n = grams(text)
                for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                    table[c] = table.get(c, 0) + k
            if sum(map(len, counts.values())) > PENDING:
                bundle()
        bundle()
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "place", "weight"])

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(run, schema).groupBy("lang", "place").agg(F.sum("weight").alias("weight"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("v")).collect()
    out = {}
    for r in sorted(found, key=lambda r: r.lang):
        v = np.array([x.weight for x in r.v])
        if len(v) and (norm := np.linalg.norm(v)) > 0:
            out[r.lang] = v / norm
    return out


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with two columns named by ``into``: the language, and its cosine with the nearest prototype (0 to 1).

    A null text, or one without a letter, gets 'und' and 0; so does every text if
    no language was learned. Of equally near languages the first by name wins.
    Columns of these names are replaced, all others pass.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dimensions)
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    def factory():
        s, m = space(dimensions), shared.value

        def compute(texts):
            langs, scores = [], []
            for text in texts:
                codes, counts = grams(text)
                lang, score = UNKNOWN, 0.0
                if len(codes) and names:
                    v = s.bundle(codes, counts)
                    norm = np.linalg.norm(v)
                    near = m @ v / norm if norm else np.zeros(len(names))
                    k = int(near.argmax())
                    lang, score = names[k], float(min(1.0, max(0.0, near[k])))
                langs.append(lang)
                scores.append(score)
            return langs, scores

        return compute

    return with_columns(df, [text_col], [T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())], factory)
