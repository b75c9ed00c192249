"""Source merging, splits, converters, hard EM."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wordlattice.operators import prep
from wordlattice.operators.segment import Options


def lines(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line long, value string")


def words(df):
    return [(r.word, r["count"]) for r in df.collect()]


def test_sources(spark):
    counts = prep.word_rows(lines(spark, "# c", "", "ក\t3", " ខ,2 ", "គ", "ឃ\tx", "abc\t4", "ា\t1", "ក​\t1"), "counts")
    assert sorted(words(counts), key=repr) == sorted([("ក", 3.0), ("ខ", 2.0), ("គ", 0.0), ("ក", 1.0)], key=repr)
    listed = prep.word_rows(lines(spark, "ក", "ង\tnote", "﻿ច"), "list")
    assert sorted(words(listed)) == [("ក", 0.0), ("ង", 0.0), ("ច", 0.0)]
    gold = prep.word_rows(lines(spark, "ក ខ ។ 12", "ក"), "gold", 2.0)
    assert sorted(words(gold)) == [("ក", 2.0), ("ក", 2.0), ("ខ", 2.0)]
    merged = prep.merge_sources(counts, listed, gold)
    assert words(merged) == [("ក", 8.0), ("ខ", 4.0), ("គ", None), ("ង", None), ("ច", None)]
    assert words(prep.merge_sources(counts, listed, gold, min_count=5)) == [("ក", 8.0), ("គ", None), ("ង", None), ("ច", None)]
    assert [r.value for r in prep.to_tsv(merged).collect()][:3] == ["ក\t8", "ខ\t4", "គ"]
    odd = spark.createDataFrame([("ក", 0.125), ("ខ", 1234567.5), ("គ", 2.0)], "word string, count double")
    assert [r.value.split("\t")[1] for r in prep.to_tsv(odd).collect()][::2] == ["0.125", "2"]
    with pytest.raises(ValueError):
        prep.word_rows(counts, "xml")


def test_splits(spark):
    texts = [f"line {i}" for i in range(300)] + ["", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.part for r in prep.hash_split(df).collect()}
    assert got == {t: "dev" if int(hashlib.sha1(t.encode()).hexdigest(), 16) % 100 < 10 else "train" for t in texts if t.strip()}
    ids = spark.createDataFrame([(f"SNT.{i}",) for i in range(100)], "sid string")
    want = {0: "test", 1: "dev"}
    assert all(r.part == want.get(int(hashlib.sha1(r.sid.encode()).hexdigest(), 16) % 10, "train") for r in prep.three_way_split(ids).collect())


def test_tagged_lines(spark):
    df = lines(spark, "ក~ខ/NN គ_ឃ/VB x/y/SYM ~/PUN plain ​ច/N")
    assert df.select(prep.from_tagged(F.col("value"))).first()[0] == ["កខ", "គឃ", "x/y", "~", "plain", "ច"]
    assert df.select(prep.from_tagged(F.col("value"), split=True)).first()[0] == ["ក", "ខ", "គ", "ឃ", "x/y", "plain", "ច"]


def test_bracketed_lines(spark):
    tokens = lines(spark, "s1\ta b c d", "s2\ta ​ b", "s3\ta b", "s4\t", "s5\ta b c", "s6\ta b")
    tags = lines(spark, "s1\tn n[n n]n v", "s2\tn n n", "s3\twrong", "s3\tn n", "s5\tn[n n n", "s6\tn")
    compound = {r.sid: r.words for r in prep.from_bracketed(tokens, tags).collect()}
    assert compound == {"s1": ["a", "bc", "d"], "s3": ["a", "b"], "s5": ["abc"]}
    atom = {r.sid: r.words for r in prep.from_bracketed(tokens, tags, "atom").collect()}
    assert atom["s1"] == ["a", "b", "c", "d"] and atom["s2"] == ["a", "b"] and "s4" not in atom


def test_hard_em(spark):
    vocabulary = spark.createDataFrame([(i, w) for i, w in enumerate(["ក", "ខ", "កខ", "គ", "ឃង"])], "line long, word string")
    gold = spark.createDataFrame([(i, s) for i, s in enumerate(["កខ គ", "កខ ឃង", "គ កខ", "ឃង គ"] * 5)], "line long, s string").select("line", F.split("s", " ").alias("gold"))
    corpus = gold.select("line", F.array_join("gold", "").alias("text")).unionByName(spark.createDataFrame([(99, "ចចច" + "គ")] * 3, "line long, text string"))
    best, scores, tally = prep.hard_em(corpus, vocabulary, gold, rounds=2)
    assert len(scores) == 3 and max(scores) == 100.0
    counts = {r.word: r["count"] for r in best.entries.collect()}
    assert set(counts) == {"ក", "ខ", "កខ", "គ", "ឃង"}
    assert [(r.word, r.n) for r in prep.candidates(tally, vocabulary, 2).collect()] == [("ចចច", 3)]
    first = prep.recount(vocabulary, vocabulary.select("word", F.lit(1).alias("n")))
    again, seen = prep.em_round(corpus, vocabulary, first, Options("fmm"))
    assert {r.word: r.n for r in seen.collect()}["កខ"] == 15 and {r.word: r["count"] for r in again.entries.collect()}["ក"] == 0


def test_gold_lines_are_those_of_column_expressions(spark, tmp_path, monkeypatch):
    """Texts of one batch are cut apart at their ends, whatever they end with."""
    from pyspark.sql import functions as F
    from wordlattice.plans import fixtures as fx

    texts = [None, "", ".", "\n\n.", "ab cd.ef", "gh", "i", " .x..y\nz ", "é😀a﻿b\x00c", "កa៝b៞c៚", "a" * 50 + ".\n" + "b", "end."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for alphabet in (fx.CLEAN, fx.MARKS):
        shown = F.filter(F.split(F.regexp_replace(F.translate("s", fx.LATIN, alphabet), "[^\\x{1780}-\\x{17DD}]+", " "), " "), lambda w: w != "")
        want = fx.sentences(spark, str(tmp_path)).select("doc_id", "sent", shown.alias("words")).where("size(words) > 0")
        for part in (1, 20, 1_000_000):
            monkeypatch.setattr(fx, "PART_CHARS", part)
            assert sorted(fx.gold(spark, str(tmp_path), alphabet).collect()) == sorted(want.collect())
