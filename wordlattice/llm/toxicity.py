"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the presence of its hashed character n-grams. Each is
scaled by the log ratio of its smoothed shares among toxic and other texts, and
a logistic regression is fitted to those whose ratio is clear. The fit uses at most
SAMPLE labelled texts (those with the smallest hash of their id); these, like
those to score, are read in whole. Executors count their n-grams and then name
each text's clear ones, so no text reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlattice.llm.common import slices, stored, with_columns

SAMPLE = 10_000
SIZES = (6, 8)
BITS = 20
ROUNDS = 100
RIDGE = 1e-3
#: An n-gram of fewer sampled texts, or with a log ratio nearer to 0, gets no weight.
LEAST = 5
CLEAR = 1.75


def hashed(text: str | None, sizes=SIZES, bits: int = BITS) -> np.ndarray:
    """Hashes of the n-grams of the lower-cased text between blanks, in order of size and place."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    parts = [np.zeros(0, np.uint64)]
    for n in sizes:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        parts.append(h >> np.uint64(64 - bits))
    return np.concatenate(parts).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS

    def score(self, text: str | None) -> float:
        h = hashed(text, self.sizes, self.bits)
        x = self.bias + float(self.weights[np.unique(h[self.weights[h] != 0])].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _constant(y: np.ndarray, sizes, bits: int) -> Model | None:
    """With no rows the score is 0.5 everywhere; with one class only, its smoothed share."""
    if len(y) and y.min() != y.max():
        return None
    share = (y.sum() + 1) / (len(y) + 2)
    return Model(np.zeros(1 << bits), float(np.log(share / (1 - share))), sizes, bits)


def _ratio(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-count ratios of the hashes from the numbers of toxic and other texts that have them; 0 where unclear."""
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((n + 1) / (n + 1).sum())
    ratio[(p + n < LEAST) | (np.abs(ratio) < CLEAR)] = 0
    return ratio


def _clear(text: str | None, clear: np.ndarray, sizes=SIZES, bits: int = BITS) -> np.ndarray:
    """A text's distinct hashes among the clear ones."""
    h = hashed(text, sizes, bits)
    return np.unique(h[clear[h]])


def fit(texts: list[str | None], labels: list[int], sizes=SIZES, bits: int = BITS) -> Model:
    """Naive Bayes ratios, then logistic regression by accelerated gradient steps."""
    y = np.array(labels, np.float64)
    if constant := _constant(y, sizes, bits):
        return constant
    p, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for text, label in zip(texts, labels, strict=True):
        (p if label else n)[hashed(text, sizes, bits)] += 1  # presence: an index counts once
    ratio = _ratio(p, n)
    return _regress([_clear(t, ratio != 0, sizes, bits) for t in texts], y, ratio, sizes, bits)


def _regress(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, sizes, bits: int) -> Model:
    """The logistic regression on each text's clear hashes."""
    ids, columns = np.repeat(np.arange(len(y)), [len(r) for r in rows]), np.concatenate(rows)
    scale = ratio[columns]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def forward(w):
        return np.bincount(ids, w[columns] * scale, len(y))

    def backward(e):
        return np.bincount(columns, e[ids] * scale, 1 << bits) / len(y)

    w = ratio.copy()
    for _ in range(8):  # the largest curvature, by power iteration
        w /= np.linalg.norm(w) or 1
        w = backward(forward(w))
    step = 1 / (0.25 * balance.max() * (1.1 * np.linalg.norm(w) + 1) + RIDGE)
    w = past = lead = np.zeros(1 << bits)
    bias = past_bias = lead_bias = 0.0
    t = 1.0
    for _ in range(ROUNDS):
        error = balance * (1 / (1 + np.exp(-np.clip(lead_bias + forward(lead), -35, 35))) - y)
        w, bias = lead - step * (backward(error) + RIDGE * lead), lead_bias - step * error.mean()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        lead, lead_bias = w + (t - 1) / t_next * (w - past), bias + (t - 1) / t_next * (bias - past_bias)
        past, past_bias, t = w, bias, t_next
    return Model(w * ratio, float(bias), sizes, bits)


def sample(documents: DataFrame, labels: DataFrame, label: str, learn, size: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``size`` rows (id, label, and the documents' other columns): labelled ids that pass ``learn``, smallest hash first.

    One label (the smallest) counts for an id that has several, and one document
    (the smallest by its columns) for an id that several share.
    """
    picked = labels.where(F.col(label).isin(0, 1) & F.coalesce(learn, F.lit(False))).groupBy(id_col).agg(F.min(label).cast("int").alias("_label"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(size)
    others = [c for c in documents.columns if c != id_col]
    rows = documents.join(F.broadcast(picked), id_col)  # at most `size` ids
    return rows.groupBy(id_col, "_label").agg(F.min(F.struct(*others)).alias("_row")).select(id_col, "_label", "_row.*")


def train(documents: DataFrame, labels: DataFrame, learn, label: str = "toxic", text_col: str = "text", id_col: str = "doc_id", size: int = SAMPLE) -> Model:
    """A model of labelled documents whose id passes the condition ``learn``."""
    rows = stored(sample(documents.select(id_col, text_col), labels, label, learn, size, id_col).select(id_col, "_label", text_col))
    y = np.array([r[0] for r in rows.select("_label", id_col).orderBy(id_col).collect()], np.float64)  # at most `size` rows
    if constant := _constant(y, SIZES, BITS):
        return constant

    def count(batches):
        p, n = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (p if label else n)[hashed(text.as_py())] += 1  # presence: an index counts once
        h = np.flatnonzero(p + n)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(p[h].astype(np.int64)), pa.array(n[h].astype(np.int64))], names=["h", "p", "n"])

    counts = rows.select("_label", text_col).mapInArrow(count, "h long, p long, n long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toArrow()  # at most 2^BITS rows
    p, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    h = counts["h"].to_numpy()
    p[h], n[h] = counts["p"].to_numpy(), counts["n"].to_numpy()
    ratio = _ratio(p, n)
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(ratio != 0))

    def factory():
        clear = np.unpackbits(shared.value).astype(bool)
        return lambda texts: [[_clear(t, clear).astype(np.int32).tobytes() for t in texts]]

    found = with_columns(rows, [text_col], [T.StructField("_clear", T.BinaryType())], factory).select(id_col, "_clear").orderBy(id_col).collect()  # at most `size` rows of clear hashes
    return _regress([np.frombuffer(r[1], np.int32).astype(np.int64) for r in found], y, ratio, SIZES, BITS)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from 0.5).

    Null and empty texts are scored as texts without words; repeated rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def compute(texts):
            scores = [m.score(t) for t in texts]
            return scores, [int(s >= 0.5) for s in scores]

        return compute

    return with_columns(df, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], factory)
