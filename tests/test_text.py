"""Clusters, normalisation, coarse tokens: Python kernels and column expressions agree with hand-made cases and with each other."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wordlattice.functions import charsets as cs
from wordlattice.functions import columns as fn
from wordlattice.functions import kernels

# one spelling or two for each unit that can follow a base, with its place in the canonical order
UNITS = {"៌": 1, "្ង": 2, "្ឧ": 2, "្រ": 2.5, "៊": 3, "\u200d": 4, "ូ": 5, "ោ": 5, "ះ": 6, "៏": 6, "\u17b5": None, "្": None}
BASES = "ញឱៜ"


def sequences(longest=3):
    """Lists of units, a lone COENG only where nothing that it could join follows."""
    for n in range(longest + 1):
        yield from itertools.product(UNITS, repeat=n)


def plain_canonical(base, units):
    if "្" in units:
        return base + "".join(units)
    kept = sorted((u for u in units if UNITS[u] is not None), key=UNITS.get)
    return base + "".join(u for k, u in enumerate(kept) if len(u) == 2 or k == 0 or u != kept[k - 1])


def plain_issues(units):
    """By the rules, unit by unit, looking back at all units before."""
    found, place = [], 1
    counted = []  # units that have a slot in the order
    for unit in units:
        slot = None if UNITS[unit] is None else int(UNITS[unit])
        if unit == "្":
            found.append((place, "dangling-coeng"))
        elif unit == "\u17b5":
            found.append((place, "inherent-vowel"))
        elif slot not in (2, 4) and unit in counted:
            found.append((place, "duplicate-mark"))
        else:
            if slot == 2 and sum(UNITS[u] in (2, 2.5) for u in counted) >= 2:
                found.append((place, "too-many-subscripts"))
            if slot == 5 and any(UNITS[u] == 5 for u in counted):
                found.append((place, "multiple-vowels"))
            if any(int(UNITS[u]) > slot for u in counted):
                found.append((place, "out-of-order"))
            counted.append(unit)
        place += len(unit)
    return found


def plain_clusters(text):
    """Code point by code point: what may begin a cluster, and what goes on with the one before."""
    of = {chr(p): c for c, ranges in cs.CLASSES.items() for a, b in ranges for p in range(a, b + 1)}
    out, open_, joining = [], False, False  # open_: marks may follow; joining: a COENG waits for a base
    for c in text:
        k = of.get(c)
        base, mark = k in cs.BASES, k in cs.MARKS
        if (open_ and (mark or k == "joiner")) or (joining and base):
            out[-1] += c
        else:
            out.append(c)
        joining = k == "coeng"
        open_ = base or mark or (open_ and k == "joiner") or k == "joiner"
    return out


def token_lists(n, seed):
    """Lists of (token, type) whose neighbours can't run together, by construction."""
    rng = random.Random(seed)
    some = lambda letters, most=5: "".join(rng.choice(letters) for _ in range(rng.randrange(1, most)))
    makers = {
        "khmer": lambda: rng.choice(BASES) + some("\u200cលឋៀ្ុ់"),
        "number": lambda: rng.choice(".,:").join(some("0489៣៧") for _ in range(rng.randrange(1, 4))),
        "latin": lambda: rng.choice("'’-").join(some("qZéłḿ") + some("4j\u0301") for _ in range(rng.randrange(1, 3))),
        "space": lambda: rng.choice([some(" \t\u00a0\u3000"), "\u200b" * rng.randrange(1, 3)]),
        "punct": lambda: rng.choice("៖៚ៗ?(»…") * rng.randrange(1, 4),
        "symbol": lambda: rng.choice("៛€=~→"),
        "other": lambda: rng.choice(["ж", "語", "\U0001f680", "\U0001f469\u200d\U0001f692", "\U0001f44b\U0001f3fe", "\ufffd", "ﻉ\u0301"]),
    }
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(0, 12)):
            kind = rng.choice(sorted(set(makers) - ({out[-1][1]} if out else set())))
            if out and {kind, out[-1][1]} == {"number", "latin"}:
                continue  # digits go on with a word
            out.append((makers[kind](), kind))
        yield out


def noise(n, seed, letters=range(0x1780, 0x17FF)):
    rng = random.Random(seed)
    pool = [chr(c) for c in letters]
    extra = ["្"] * 8 + [" ", " ", "​", "‌", "‍", "a", "Z", "1", "៣", ".", ",", "'", "-", "́", "\U0001f468", "\U0001f3fd", "é", "$", "!", "!", "ៗ", "﻿", "’", "\n"]
    return ["".join(rng.choice(pool if rng.random() < 0.6 else extra) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    made = {b + "".join(u) for u in sequences(2) for b in BASES} | {"".join(t for t, _ in tokens) for tokens in token_lists(300, 4)}
    rows = sorted({*made, *noise(1500, 1), *noise(500, 2, range(0x17B4, 0x17DE))})
    return spark.createDataFrame([(t,) for t in rows], "text string").cache()


def test_clusters():
    for text in [*noise(3000, 8), *noise(1000, 9, range(0x17B4, 0x17DE))]:
        assert kernels.clusters(text) == plain_clusters(text), text.encode("unicode_escape")


def test_every_short_cluster():
    """Canonical form and issues of every sequence of up to three units, by plain rules."""
    for units in sequences():
        for base in BASES:
            text = base + "".join(units)
            if kernels.clusters(text) == [text] and "្្" not in text:
                assert kernels.normalize(text) == plain_canonical(base, units), text.encode("unicode_escape")
                assert kernels.cluster_issues(text) == plain_issues(units), text.encode("unicode_escape")


def test_issues_of_later_clusters():
    assert kernels.cluster_issues("z៎") == [(1, "orphan-mark")]
    assert kernels.cluster_issues("ញូ៌ ឱ\u17b5") == [(2, "out-of-order"), (5, "inherent-vowel")]
    assert kernels.cluster_issues("") == [] and kernels.normalize("") == "" and kernels.pretokenize("") == []


def test_pretokenize():
    for tokens in token_lists(2000, 6):
        assert kernels.pretokenize("".join(t for t, _ in tokens)) == tokens


def test_invariants():
    for text in noise(3000, 3):
        assert "".join(kernels.clusters(text)) == text
        assert "".join(t for t, _ in kernels.pretokenize(text)) == text
        once = kernels.normalize(text)
        assert kernels.normalize(once) == once
        assert len(kernels.clusters(once)) == len(kernels.clusters(text))


def test_columns_agree_with_kernels(texts):
    rows = texts.select(
        "text", fn.clusters(F.col("text")).alias("c"), fn.normalize(F.col("text")).alias("n"), fn.pretokenize(F.col("text")).alias("p"),
        fn.cluster_issues(F.col("text")).alias("i"), fn.boundaries(F.col("text")).alias("b"), F.transform(fn.clusters(F.col("text")), fn.is_orphan).alias("o"),
    ).collect()
    for r in rows:
        want = kernels.clusters(r.text)
        assert r.c == want
        assert r.n == kernels.normalize(r.text)
        assert [tuple(t) for t in r.p] == kernels.pretokenize(r.text)
        assert [tuple(i) for i in r.i] == kernels.cluster_issues(r.text), r.text.encode("unicode_escape")
        assert r.b == [sum(map(len, want[:k])) for k in range(len(want) + 1)]
        assert r.o == [kernels.is_orphan(c) for c in want]


def test_worked_boundaries(spark):
    text = "ខ្ញុំស្រលាញ់ប្រទេសកម្ពុជា"
    assert spark.createDataFrame([(text,)], "t string").select(fn.boundaries(F.col("t"))).first()[0] == [0, 5, 8, 10, 12, 15, 17, 18, 19, 23, 25]


def test_patterns_agree_with_duckdb(texts):
    import duckdb

    rows = [r.text for r in texts.collect()]
    c = duckdb.connect()
    c.execute("create table t(x varchar)")
    c.executemany("insert into t values (?)", [(r,) for r in rows])
    got = c.execute("select x, regexp_extract_all(x, ?), regexp_extract_all(x, ?) from t", [cs.cluster_pattern("re2"), cs.pretoken_pattern("re2")]).fetchall()
    for text, clusters, tokens in got:
        assert clusters == kernels.clusters(text)
        assert tokens == [t for t, _ in kernels.pretokenize(text)]


BAD = [(b"\x80", 1, 1), (b"\xc0\x80", 2, 2), (b"\xe0\x80\x80", 3, 3), (b"\xed\xa0\x80", 3, 3), (b"\xf4\x90\x80\x80", 4, 4), (b"\xf5\x80", 2, 2), (b"\xe1\x9e", 1, 1), (b"\xe1\x9eA", 1, 2), (b"\xf0\x9f\x98x", 1, 2)]


def test_repair(spark):
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _, _) in enumerate(BAD)], "i int, b binary")
    for r in df.select("i", fn.repair(F.col("b")).alias("t")).collect():
        _, replaced, points = BAD[r.i]
        assert (r.t.count("�"), len(r.t)) == (replaced, points)
    with pytest.raises(Exception, match="INVALID_UTF8_STRING"):
        df.select(fn.strict(F.col("b"))).collect()


def test_small_functions(spark):
    def one(expr):
        return spark.range(1).select(expr).first()[0]

    assert one(fn.split_words(F.lit("  ab \tc  de\r"))) == ["ab", "c", "de"]
    assert one(fn.split_words(F.lit("   "))) == []
    assert one(fn.join_words(F.array(F.lit("ab"), F.lit("c")))) == "abc"
    assert one(fn.trim(F.lit(" \t a b\t \r"))) == "a b"
    numbers = {"3": 3.0, "-2.5": -2.5, "+5": 5.0, ".5": 0.5, "1e3": 1000.0, "1d": None, "0x1p3": None, "NaN": None, "inf": None, "1e999": None, "lots": None, "": None}
    for text, want in numbers.items():
        assert one(fn.parse_double(F.lit(text))) == want, text
    assert one(fn.hex_code(F.lit("a"))) == "U+0061"
    assert [one(fn.is_punct_word(F.lit(w))) for w in ("។", "!?", "a!", "")] == [True, True, False, False]
    import hashlib

    for text in ("", "x", "ញូឱ្យ"):
        assert one(fn.sha1_bucket(F.lit(text), 100)) == int(hashlib.sha1(text.encode()).hexdigest(), 16) % 100
    assert [one(fn.reject_reason(F.lit(w))) for w in ("", "ញq", "៌ញ", "ញូឱ្យ")] == ["empty word", "contains non-Khmer character U+0071", "starts with a mark", None]


def test_class_table_against_unicode_names():
    import unicodedata

    for name, ranges in cs.CLASSES.items():
        for a, b in ranges:
            for p in range(a, b + 1):
                title = unicodedata.name(chr(p), "")
                if name == "digit":
                    assert "DIGIT" in title
                if name == "cons":
                    assert "LETTER" in title
    seen = [p for ranges in cs.CLASSES.values() for a, b in ranges for p in range(a, b + 1)]
    assert len(seen) == len(set(seen))
    kinds = [p for ranges in cs.KINDS.values() for a, b in ranges for p in range(a, b + 1)]
    assert len(kinds) == len(set(kinds))


def test_very_long_clusters_and_tokens(spark):
    """A greedy group in Java's patterns takes a stack frame for each turn: these texts ended the executor."""
    texts = ["ក" + "ូវាុា" * 4000, "ូា" * 15000, "ក" + "្ក" * 20000, "ក" + "្" * 20000, "1," * 20000 + "1", "a-" * 20000 + "a", "😀" + "‍😀" * 20000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", fn.clusters(F.col("text")).alias("c"), fn.pretokenize(F.col("text")).alias("p"), fn.normalize(F.col("text")).alias("n"), F.col("text")).collect()
    for r in rows:
        if r.text is None:
            assert r.c is None and r.p is None and r.n is None
            continue
        assert r.c == kernels.clusters(r.text) and r.n == kernels.normalize(r.text)
        assert [t.text for t in r.p] == [t for t, _ in kernels.pretokenize(r.text)]


def test_issues_of_long_texts_by_blocks(spark):
    texts = ["ក" + "ា" * (2 * fn.BLOCK + 3), "ក្្ា" * (fn.BLOCK + 1), "ា" * fn.BLOCK, "ក" * fn.BLOCK + "៎", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fn.cluster_issues(F.col("text")).alias("i")).collect()
    for r in rows:
        assert r.i is None if r.text is None else [tuple(i) for i in r.i] == kernels.cluster_issues(r.text)
