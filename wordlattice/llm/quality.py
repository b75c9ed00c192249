"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted regression trees of depth three are grown on the statistics of labelled
texts. Each path from a root is a conjunctive rule (a few bounds on statistics);
a lasso logistic regression keeps a few of these rules, and the kept ones are
compiled into one Spark column expression over the statistics.

The fit uses at most SAMPLE labelled texts (those with the smallest hash of
their id); every text is scored in whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlattice.llm.common import unused, with_columns
from wordlattice.llm.toxicity import sample

SAMPLE = 20_000
TREES = 40
DEPTH = 3
BINS = 32
#: Strength of the lasso, as a share of the strength that drops every rule.
LASSO = 0.01
ROUNDS = 400
STATISTICS = (
    "chars", "words", "word_length", "longest_word", "upper", "digits", "blanks", "punctuation", "symbols", "non_ascii",
    "distinct_words", "top_word", "lines", "line_length", "repeated_lines", "symbol_ends", "shouted", "bars", "repeated_words",
)

_UPPER, _DIGIT, _BLANK, _PUNCT, _SYMBOL, _HIGH = range(1, 7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = _PUNCT
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL
_CLASS[128:] = _HIGH


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for a text; shares of nothing are 0."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    count = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7).tolist()
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, size = len(words), max(1, len(data))
    seen = Counter(words)
    shouted = sum(map(str.isupper, words))
    return [
        float(len(text)), float(n), sum(map(len, words)) / max(1, n), float(max(map(len, words), default=0)),
        count[_UPPER] / size, count[_DIGIT] / size, count[_BLANK] / size, count[_PUNCT] / size, count[_SYMBOL] / size, count[_HIGH] / size,
        len(seen) / max(1, n), max(seen.values(), default=0) / max(1, n), float(len(lines)), len(text) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / max(1, n), shouted / max(1, n), text.count("|") / max(1, n), sum(map(str.__eq__, words, words[1:])) / max(1, n),
    ]


def with_statistics(df: DataFrame, text_col: str = "text", into: str = "stat") -> DataFrame:
    """``df`` with ``into``, a struct of STATISTICS; null counts as empty, an empty table stays empty."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])

    def factory():
        return lambda texts: [[dict(zip(STATISTICS, statistics(t), strict=True)) for t in texts]]

    return with_columns(df, [text_col], [T.StructField(into, kind)], factory)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (statistic, True for <=, bound)."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, bound in self.bounds:
            out &= (x[:, k] <= bound) if below else (x[:, k] > bound)
        return out

    def column(self, stat: str) -> Column:
        out = F.lit(True)
        for k, below, bound in self.bounds:
            c = F.col(f"{stat}.{STATISTICS[k]}")
            out = out & ((c <= F.lit(bound)) if below else (c > F.lit(bound)))
        return out


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def margin(self, stat: str = "stat") -> Column:
        """The ensemble as one Spark expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(stat), F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The same in numpy, for tests."""
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        z = self.bias + sum((r.holds(x) * w for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def _tree(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, path: tuple, depth: int, paths: list, fitted: np.ndarray, least: int) -> None:
    """Grows a regression tree by variance; notes the path to each node and the leaves' means."""
    if path:
        paths.append(path)
    best, total = None, target[rows].sum()
    if depth and len(rows) >= 2 * least:
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            place = np.searchsorted(c, x[rows, k], side="left")  # bin i: at most cut i
            n = np.cumsum(np.bincount(place, minlength=len(c) + 1))[:-1]
            s = np.cumsum(np.bincount(place, target[rows], len(c) + 1))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if ok.any():
                gain = np.where(ok, s * s / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), -1)
                i = int(gain.argmax())
                if best is None or gain[i] > best[0] + 1e-12:
                    best = gain[i], k, float(c[i])
    if best is None or best[0] <= total * total / len(rows) + 1e-9:
        fitted[rows] = total / max(1, len(rows))
        return
    _, k, bound = best
    below = x[rows, k] <= bound
    _tree(x, cuts, target, rows[below], (*path, (k, True, bound)), depth - 1, paths, fitted, least)
    _tree(x, cuts, target, rows[~below], (*path, (k, False, bound)), depth - 1, paths, fitted, least)


def _tightest(path: tuple) -> tuple:
    """One bound for each statistic and direction, in a fixed order."""
    out: dict[tuple[int, bool], float] = {}
    for k, below, bound in path:
        old = out.get((k, below))
        out[k, below] = bound if old is None else (min if below else max)(old, bound)
    return tuple(sorted((k, below, bound) for (k, below), bound in out.items()))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from boosted trees, weighed by lasso logistic regression.

    With no rows the score is 0.5 everywhere; with one class only, its smoothed share.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model([], [], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    paths: list[tuple] = []
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    draw = np.random.default_rng(0)
    for _ in range(TREES):
        rows = np.sort(draw.choice(len(y), max(1, int(0.7 * len(y))), replace=False))
        residual, fitted = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        _tree(x, cuts, residual, rows, (), DEPTH, paths, fitted, max(4, len(y) // 200))
        margin += 2.0 * fitted
    rules, columns, seen = [], [], set()
    for path in dict.fromkeys(map(_tightest, paths)):
        rule = Rule(path)
        held = rule.holds(x)
        if 0 < held.sum() < len(y) and (key := held.tobytes()) not in seen:  # rules that agree on all rows: the first
            seen.add(key)
            rules.append(rule)
            columns.append(held)
    f = np.array(columns, np.float64).T.reshape(len(y), len(rules))
    w, bias = _lasso(f, y)
    keep = np.flatnonzero(w)
    return Model([rules[i] for i in keep], [float(w[i]) for i in keep], float(bias))


def _lasso(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the bias is free."""
    n = len(y)
    strength = LASSO * np.abs(f.T @ (y - y.mean())).max(initial=0) / n
    full = np.column_stack((f, np.ones(n)))
    step = 4 * n / max(1e-9, np.linalg.eigvalsh(full.T @ full)[-1])
    w = past = lead = np.append(np.zeros(f.shape[1]), np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(ROUNDS):
        gradient = full.T @ (1 / (1 + np.exp(-np.clip(full @ lead, -35, 35))) - y) / n
        w = lead - step * gradient
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step * strength, 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        lead = w + (t - 1) / t_next * (w - past)
        past, t = w, t_next
    return w[:-1], w[-1]


def train(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", text_col: str = "text", id_col: str = "doc_id", size: int = SAMPLE) -> Model:
    """A model of labelled documents whose id passes the condition ``learn``."""
    rows = with_statistics(sample(documents.select(id_col, text_col), labels, label, learn, size, id_col), text_col)
    found = rows.select(id_col, "_label", "stat").orderBy(id_col).collect()  # at most `size` rows of statistics
    return fit(np.array([list(r[2]) for r in found]).reshape(len(found), len(STATISTICS)), np.array([r[1] for r in found], np.float64))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from 0.5).

    Null and empty texts are scored by the statistics of an empty text; repeated rows stay, and an empty table gives an empty one. Columns
    named score or predicted are replaced, all others pass.
    """
    stat = unused(df, "stat")
    scored = with_statistics(df, text_col, stat).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin(stat))))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop(stat)
