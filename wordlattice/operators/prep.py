"""Corpus preparation: merging sources, splits, format converters, count estimation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordlattice.functions import charsets as cs
from wordlattice.functions import columns as fn
from wordlattice.operators import evaluate
from wordlattice.operators.segment import Options, segment, words
from wordlattice.sources.lexicon import Lexicon, Meta, meta_of, numbered, with_costs

KINDS = ("counts", "list", "icu", "gold")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean(word: Column) -> Column:
    """Without white space at the ends, zero-width spaces and byte order marks."""
    return F.translate(strip(word), cs.ZWSP + "﻿", "")


def acceptable(word: Column) -> Column:
    """Does a word begin with a base and hold Khmer letters and joiners only?"""
    return word.rlike(f"^[{cs.klass(*cs.BASES)}][{cs.kind('khmer')}{cs.kind('joiner')}]*\\z")


def word_rows(lines: DataFrame, kind: str, weight: float | None = None, text_col: str = "value") -> DataFrame:
    """(word, count) of one source's lines; a list has weight 0 unless told otherwise, others 1.

    Kinds: 'counts' (word, tab or comma, number), 'list' and 'icu' (a word a line),
    'gold' (segmented text). Blank lines and comments are left out, and so are
    lines of 'counts' with a bad number.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown source kind {kind!r}")
    weight = (0.0 if kind in ("list", "icu") else 1.0) if weight is None else float(weight)
    rows = lines.select(strip(F.col(text_col)).alias("line")).where("line <> '' and not startswith(line, '#')")
    if kind == "gold":
        out = rows.select(F.explode(F.split("line", r"(?U)\s+")).alias("word"), F.lit(weight).alias("count"))
    elif kind == "counts":
        parts = F.split("line", F.when(F.col("line").contains("\t"), "\t").otherwise(","), 2)
        raw = strip(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        out = rows.select(parts[0].alias("word"), F.when(raw == "", 0.0).otherwise(fn.parse_double(raw) * weight).alias("count")).where("count is not null")
    else:
        out = rows.select(F.split("line", "\t")[0].alias("word"), F.lit(weight).alias("count"))
    return out.select(clean(F.col("word")).alias("word"), "count").where(acceptable(F.col("word")))


def merge_sources(*sources: DataFrame, min_count: float = 0.0) -> DataFrame:
    """(word, count) over all sources, most frequent first; a word that no source counts has no count and is always kept."""
    rows = reduce(DataFrame.unionByName, sources)
    merged = rows.groupBy("word").agg(F.sum(F.when(F.col("count") != 0, F.col("count"))).alias("count"))
    if min_count > 0:
        merged = merged.where((F.col("count") >= min_count) | F.col("count").isNull())
    return merged.orderBy(F.desc(F.coalesce("count", F.lit(0.0))), "word")


def gold_word_counts(gold: DataFrame, words_col: str = "words", weight: float = 1.0) -> DataFrame:
    """(word, count) of segmented text."""
    return gold.select(F.explode(words_col).alias("word")).groupBy("word").agg((F.count("*") * weight).alias("count"))


def to_tsv(merged: DataFrame) -> DataFrame:
    """Lexicon lines of (word, count); counts have six significant digits at most."""
    plain = F.regexp_replace(F.format_string("%.6g", F.col("count")), r"(\.\d*?)0+$", "$1")
    shown = F.when(F.col("count") == F.floor("count"), F.col("count").cast("long").cast("string")).otherwise(F.regexp_replace(plain, r"\.$", ""))
    return merged.select(F.when(F.coalesce("count", F.lit(0.0)) != 0, F.concat_ws("\t", "word", shown)).otherwise(F.col("word")).alias("value"))


def hash_split(df: DataFrame, text_col: str = "text", dev_percent: int = 10) -> DataFrame:
    """``df`` without blank lines, with ``part``: 'dev' or 'train' by the text's SHA-1, wherever the line stands."""
    kept = df.where(F.col(text_col).rlike(r"(?U)\S"))
    return kept.withColumn("part", F.when(fn.sha1_bucket(F.col(text_col), 100) < dev_percent, "dev").otherwise("train"))


def three_way_split(df: DataFrame, id_col: str = "sid") -> DataFrame:
    """``df`` with ``part``: a tenth 'test', a tenth 'dev', the rest 'train' by the id's SHA-1."""
    bucket = fn.sha1_bucket(F.col(id_col), 10)
    return df.withColumn("part", F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train"))


def from_tagged(line: Column, split: bool = False) -> Column:
    """Words of a line of ``word/TAG`` tokens; ~ and _ join the parts of a compound, or split it."""
    tokens = F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")
    bare = F.transform(tokens, lambda t: F.translate(F.when(t.contains("/"), F.regexp_extract(t, r"(?s)^(.*)/[^/]*\z", 1)).otherwise(t), cs.ZWSP, ""))
    if split:
        return F.filter(F.flatten(F.transform(bare, lambda w: F.split(w, r"(?U)[~_\s]+"))), lambda w: w != "")
    return F.filter(F.transform(bare, lambda w: F.when(F.translate(w, "~_", "") == "", w).otherwise(F.translate(w, "~_", ""))), lambda w: w != "")


def from_bracketed(tokens: DataFrame, tags: DataFrame, level: str = "compound") -> DataFrame:
    """(sid, words) from (line, value) rows of ``sid<TAB>tokens`` and of the same ids' tags.

    At level 'compound' the tokens of a top-level bracket group are one word, and
    sentences whose tokens and tags differ in number are dropped. Of repeated ids
    the last tags count.
    """
    def parts(df):
        pair = F.split("value", "\t", 2)
        return df.select("line", pair[0].alias("sid"), F.filter(F.split(F.coalesce(F.get(pair, F.lit(1)), F.lit("")), r"(?U)\s+"), lambda t: t != "").alias("items"))

    clean_items = F.filter(F.transform("items", lambda t: F.translate(t, cs.ZWSP, "")), lambda t: t != "")
    rows = parts(tokens).select("line", "sid", clean_items.alias("tokens")).where("size(tokens) > 0")
    if level == "atom":
        return rows.select("line", "sid", F.col("tokens").alias("words"))
    last = parts(tags).groupBy("sid").agg(F.max_by("items", "line").alias("tags"))
    joined = rows.join(last, "sid", "left").where("size(tokens) = size(coalesce(tags, cast(array() as array<string>)))")
    return joined.select("line", "sid", bracket_groups(F.col("tokens"), F.col("tags")).alias("words"))


def bracket_groups(tokens: Column, tags: Column) -> Column:
    """Words of tokens whose tags open and close bracket groups; a group left open ends with the line."""
    text = "array<string>"
    start = F.struct(F.array().cast(text).alias("words"), F.lit("").alias("open"), F.lit(False).alias("inside"), F.lit(0).alias("depth"))

    def step(s: Column, x: Column) -> Column:
        opens, closes = F.regexp_count(x["tag"], F.lit(r"\[")), F.regexp_count(x["tag"], F.lit(r"\]"))
        alone = (s["depth"] == 0) & (opens == 0)
        depth = s["depth"] + opens - closes
        text_now = F.concat(s["open"], x["token"])
        done = depth <= 0
        words_now = F.when(alone, F.array_append(s["words"], x["token"])).when(done, F.array_append(s["words"], text_now)).otherwise(s["words"])
        return F.struct(words_now.alias("words"), F.when(alone, s["open"]).when(done, "").otherwise(text_now).alias("open"), F.when(alone, s["inside"]).otherwise(~done).alias("inside"), F.when(alone | done, 0).otherwise(depth).alias("depth"))

    pairs = F.transform(F.arrays_zip(tokens.alias("token"), tags.alias("tag")), lambda x: F.struct(x["token"].alias("token"), x["tag"].alias("tag")))
    return F.aggregate(pairs, start, step, lambda s: F.when(s["inside"], F.array_append(s["words"], s["open"])).otherwise(s["words"]))


# -- hard EM --------------------------------------------------------------------------------


def tally(corpus: DataFrame, lexicon: Lexicon, options: Options = Options(), text_col: str = "text") -> DataFrame:
    """(word, n): how often each token text occurs when the corpus is segmented."""
    tokens = segment(corpus, lexicon, options, text_col, "_tokens")
    return tokens.select(F.explode(words(F.col("_tokens"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def recount(vocabulary: DataFrame, counts: DataFrame) -> Lexicon:
    """A lexicon of the vocabulary (line, word) with the tally's counts; words that don't occur have none."""
    rows = vocabulary.select("line", "word").join(counts, "word", "left").select("line", "word", F.col("n").cast("double").alias("value"))
    entries = numbered(with_costs(rows)).persist()
    return Lexicon(entries, meta_of(entries))


def em_round(corpus: DataFrame, vocabulary: DataFrame, lexicon: Lexicon, options: Options = Options(), text_col: str = "text") -> tuple[Lexicon, DataFrame]:
    """One round of hard EM: segment, count, re-estimate. Also gives the tally."""
    counts = tally(corpus, lexicon, options, text_col)
    return recount(vocabulary, counts), counts


def hard_em(corpus: DataFrame, vocabulary: DataFrame, dev: DataFrame, rounds: int = 4, prior: DataFrame | None = None, options: Options = Options(), text_col: str = "text", words_col: str = "gold") -> tuple[Lexicon, list[float], DataFrame | None]:
    """The best lexicon of hard EM by F1 on ``dev`` in percent with two decimals, the F1 of each round, and the last tally.

    Starts from a count of 1 for each word, or from ``prior`` (word, n). Lexicons
    are checkpointed to the session's checkpoint folder each round.
    """
    start = prior if prior is not None else vocabulary.select("word", F.lit(1).alias("n"))
    lexicon, best, scores, counts = recount(vocabulary, start), None, [], None
    for k in range(rounds + 1):
        row = evaluate.summary(evaluate.with_scores(evaluate.predict(dev, lexicon, options, words_col), words_col)).first()
        scores.append(round(row.f1 * 100, 2))
        if best is None or scores[-1] > max(scores[:-1]):
            best = lexicon
        if k < rounds:
            lexicon, counts = em_round(corpus, vocabulary, lexicon, options, text_col)
            if corpus.sparkSession.sparkContext.getCheckpointDir():
                lexicon = Lexicon(lexicon.entries.checkpoint(), lexicon.meta)
    return best, scores, counts


def candidates(counts: DataFrame, vocabulary: DataFrame, least: int = 20) -> DataFrame:
    """Frequent token texts that begin with a Khmer letter and aren't in the vocabulary."""
    letter = F.col("word").rlike(f"^[{cs.klass('cons', 'indv')}]")
    return counts.where(letter & (F.col("n") >= least)).join(vocabulary.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word")
