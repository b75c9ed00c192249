"""Operators on single texts against brute force, exact round trips or held-out accuracy."""

import hashlib
import pickle
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordlattice.llm import bpe, decontam, langid, pii, quality, toxicity

ODD = ["", " ", "\n\n\n", "a", "A b", "é", "\U0001f600" * 40, "a" * 3000, " " * 2000 + "x", "1" * 2500, "don't  stop\t\tnow", "�", "日本語のテキスト" * 20, "<|endoftext|>", "x\x1c\x1dy\x85z", "ab" * 700 + "!" * 900]
ROWS = [*enumerate(ODD), (100, None), (0, ""), (0, ""), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("N_TOKENS", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_bpe_equals_library(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_bpe_tree_on_long_matches(codec, reference):
    rng = random.Random(2)
    for alphabet in ("a", "ab", "abcdefgh", "etaoin", "0123456789", "éèàa", "!?.", " "):
        for n in (25, 49, 100, 513, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert codec.encode(text) == reference.encode_ordinary(text)


def test_bpe_join_is_associative(codec):
    rng = random.Random(4)
    for _ in range(200):
        parts = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(0, 40))).encode() for _ in range(3)]
        x, y, z = (codec.tree(p) if p else [] for p in parts)
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == (codec.merge(b"".join(parts)) if b"".join(parts) else [])


def test_bpe_merges_agree(codec, reference):
    """Both merges of a window give what the library gives for one match of its pattern (letters only)."""
    rng = random.Random(6)
    for n in (2, 3, 17, 48, 49, 150, 400):
        text = "".join(rng.choice("abcdefgh") for _ in range(n))
        if text.encode() not in codec.ranks:
            assert codec._merge_long(text.encode()) == codec.merge(text.encode()) == reference.encode_ordinary(text)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_bpe_decodes_by_trees_of_any_fan(monkeypatch, fan):
    monkeypatch.setattr(bpe, "FAN", fan)
    own = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    ids = own.encode("many words, é and ក, again and again " * 20)
    for n in (0, 1, 2, fan - 1, fan, fan + 1, fan * fan, fan * fan + 1, len(ids)):
        assert own.decode(ids[:n]) == b"".join(own.bytes_of[i] for i in ids[:n])


def test_bpe_matches_go_through_joins(spark):
    """Every match of a whole table that isn't one token is put together by joins; only equal short halves are remembered."""
    own = bpe.ByteBPE(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    matches = {m.encode() for t in texts for m in own.find(t or "")}
    for t in texts:
        own.encode(t or "")
    joined = [m for m in matches if m not in own.ranks]
    assert len(joined) > 5_000
    assert sum(len(m) > bpe.LEAF for m in joined) <= own.joins <= sum(len(m) - 1 for m in joined)
    # each short subtree is made once, by a join of its halves
    assert own.leaf.cache_info().misses > 1_000 and all(len(m) > bpe.LEAF or own.leaf(m) == own.encode_match(m) for m in joined)


def test_bpe_queries(odd, reference):
    got = bpe.round_trip(odd)
    assert got.count() == len(ROWS)
    for r in got.collect():
        ids = reference.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(odd))
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    assert bpe.round_trip(odd.limit(0)).collect() == []


# -- personal data -----------------------------------------------------------------------------


def plain_spans(text):
    """The base kinds by their plain patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


PII = [
    "mail a.b+c@d-e.example.com, or x@y", "a@b@c.de", "a@b.c_d@e.f.g", "@x.y", "é.a@b.cc.", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "10.0.0.1", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111", "4111  1111", "+1 (415) 555-0100", "+12", "+1 2 3 4 5 6 7 8 (", "++49 30 1234567", "+1.2.3.4 +1234567890123456",
    "00000000000000000", "a@b.c" * 40, "1" * 5000, "a" * 5000 + "@", "." * 3000, "+" * 3000, "1.1." * 800,
]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@+- ()é4", max_size=60) | st.sampled_from(PII))
def test_pii_base_equals_plain_patterns(text):
    assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == plain_spans(text)


def test_pii_added_kinds():
    found = lambda t: [(k, t[s:e]) for k, s, e, _ in pii.find(t) if k not in pii.BASE]
    assert found("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("DE89370400440532013001") == []
    assert found("my social security number 123-45-6789") == [("ssn", "123-45-6789")]
    assert found("part 123-45-6789") == [] and found("ssn 000-45-6789") == []
    email = lambda t: next(p for k, _, _, p in pii.find(t) if k == "email")
    assert email("contact me: a@b.de") > email("xx yy: a@b.de") > email("sample: a@b.de")


def test_pii_ibans_before_other_words():
    found = lambda t: [t[s:e] for k, s, e, _ in pii.find(t) if k == "iban"]
    plain, blanks = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for text in ("IBAN {} BIC X", "bank {} BIC COBADEFFXXX", "{} 2026 12", "{} A", "REF AB12 CDEF GHIJ KLMN {} BIC", "{}", "({})", "NO 12 {} X1 Y2"):
        assert found(text.format(plain)) == [plain] and found(text.format(blanks)) == [blanks], text
    assert found(f"{blanks} {plain} GB82 WEST 1234 5698 7654 32 OK") == [blanks, plain, "GB82 WEST 1234 5698 7654 32"]
    assert found("DE89370400440532013001 BIC X") == [] and found(plain + "x") == []
    text = f"IBAN {blanks} BIC X"
    assert pii.mask(text, pii.find(text)) == "IBAN [IBAN] BIC X"
    assert found("AB12 " * 5000) == []


def test_pii_report_and_mask(spark, odd):
    text = "write a@b.de or +1 (415) 555-0100, card 4111 1111 1111 1111 at 10.0.0.1"
    df = spark.createDataFrame([(1, text, "en"), (2, None, None), (3, "", "en"), (4, "clean text 12", "en")], "doc_id long, text string, n_card string")
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    assert [rows[1][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1]
    assert rows[1].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(text))
    assert rows[1].base_sha256 == hashlib.sha256(rows[1].spans.encode()).hexdigest()
    assert rows[2].base_sha256 == rows[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    hidden = pii.masked(df)
    assert hidden.columns == df.columns
    texts = {r.doc_id: r.text for r in hidden.collect()}
    assert texts == {1: "write [EMAIL] or [PHONE], card [CARD] at [IP]", 2: None, 3: "", 4: "clean text 12"}
    assert pii.detect(df).where("doc_id = 1").select(F.size("pii")).first()[0] == 4
    assert pii.report(odd).count() == len(ROWS)


# -- decontamination ---------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_report(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        x = plain_words(body)
        size = min(10, len(x))
        for i in range(len(x) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == x[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "Été"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(1, items[0][1]), (None, "null item words here"), (77, ""), (78, None), (79, "!!!")]
    docs = []
    for k in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if k % 2:
            at, text = rng.randrange(0, len(parts) + 1), rng.choice(items[:25])[1]
            parts[at:at] = text.upper().split() if k % 4 == 1 else text.split()
        docs.append((k, rng.choice([" ", ", ", "\n", "-"]).join(parts)))
    return docs + [(100, None), (101, ""), (0, "x null ITEM words, here y")], items


def test_windows_against_every_pair():
    rng = random.Random(7)
    for _ in range(300):
        vocabulary = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(4)]
        items = [(rng.choice([None, f"i{k}"]), " ".join(rng.choices(vocabulary, k=rng.randrange(9)))) for k in range(rng.randrange(6))]
        tokens = decontam.words(" ".join(rng.choices(vocabulary, k=rng.randrange(30))))
        hit, found = [False] * len(tokens), set()
        for item, text in items:
            own = decontam.words(text)
            size = min(4, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                for j in range(len(tokens) - size + 1):
                    if tokens[j : j + size] == own[i : i + size]:
                        found.add(item)
                        hit[j : j + size] = [True] * size
        flags, names = decontam.Windows(items, 4).scan(tokens)
        assert (flags.tolist(), names) == (hit, found)


def test_windows_are_small():
    rng = random.Random(8)
    items = [(str(k), " ".join(f"{rng.getrandbits(24):x}" for _ in range(400))) for k in range(300)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontam.Windows(items))) < 5 * size


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block * 25)
    docs, items = bench_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(df, bench).collect())
    assert got == sorted((i, *plain_report(t, items)) for i, t in docs)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    assert decontam.report(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(df.limit(0), bench).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_columns_named_like_inner_ones_pass(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    names = ["stat", "_HITS", "_items", "_total", "_lost", "_gone", "__gone", "_again"]
    passage = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(1, "clean words"), (2, "clean " * 60 + passage), (3, passage), (4, None)], "doc_id long, text string")
    df = df.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    bench = spark.createDataFrame([(9, passage), (10, "v" * 200), (11, "u" * 200)], "item_id long, text string")
    model = quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    cases = [
        (decontam.filter_spans(df, bench), [1, 2, 4], []),
        (decontam.report(df, bench), [1, 2, 3, 4], ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
        (quality.predict(df, model), [1, 2, 3, 4], ["score", "predicted"]),
    ]
    for out, ids, new in cases:
        assert out.columns == df.columns + new
        rows = out.orderBy("doc_id").collect()
        assert [r.doc_id for r in rows] == ids
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_scores_of_empty_tables(spark, odd):
    model = quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert quality.predict(odd.limit(0), model).collect() == []
    assert langid.predict(odd.limit(0), {}).collect() == []
    assert pii.report(odd.limit(0)).collect() == [] and pii.masked(odd.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination_filter(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    passage = " ".join(f"q{i}" for i in range(20))
    clean = "Some clean words, here; and there."
    rows = [(1, clean), (2, f"{clean} " * 6 + passage.upper() + f" tail. {clean}"), (3, passage), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    bench = spark.createDataFrame([(9, passage), (10, "v" * 200), (11, "u" * 200)], "item_id long, text string")
    assert decontam.block_count(bench) == (1 if block > 1000 else 5)
    out = decontam.filter_spans(df, bench)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == {1, 2, 4, 5} and got[1] == clean and got[4] is None and got[5] == ""
    assert "Q0" not in got[2] and got[2].endswith(f"tail. {clean}")
    assert not decontam.report(out, bench).where("contaminated").count()
    # what a cut brings together is cut as well
    words = passage.split()
    seam = spark.createDataFrame([(1, " ".join(["a"] * 200 + words[:5] + words + words[5:]))], "doc_id long, text string")
    assert not decontam.report(decontam.filter_spans(seam, bench), bench).where("contaminated").count()


# -- classifiers ----------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(9)
    syllables = {"en": "the ing ion and her".split(), "fr": "eau ment que é oi".split(), "de": "ung sch ich ä keit".split()}

    def text(lang):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))

    rows = [(i, text(lang), lang) for i in range(300) for lang in [rng.choice(list(syllables))]]
    train = spark.createDataFrame([*rows[:200], (900, None, "en"), (901, "zzz", None)], "doc_id long, text string, lang string")
    prototypes = langid.train(train)
    assert sorted(prototypes) == ["de", "en", "fr"]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in prototypes.values())
    again = langid.train(train.repartition(7))
    assert all(np.allclose(prototypes[k], again[k]) for k in prototypes)
    test = spark.createDataFrame([*rows[200:], (900, None, None), (901, "", None), (902, "123 !?", None), (903, "a", None), (904, "日本" * 4000, None)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.predict(test, prototypes).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows[200:]) >= 97
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred in prototypes and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(test, langid.train(train.limit(0))).collect()} == {"und"}
    assert langid.predict(test.limit(0), prototypes).collect() == []


def test_language_id_vectors():
    s = langid.Space(512)
    codes, counts = langid.grams("Ab, ab!")
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {(ord(a) << 42) | (ord(b) << 21) | ord(c): n for (a, b, c), n in {" ab": 2, "ab ": 2, "b a": 1}.items()}
    want = sum(n * np.roll(s.letter(c >> 42), 2) * np.roll(s.letter((c >> 21) & 0x1FFFFF), 1) * s.letter(c & 0x1FFFFF) for c, n in zip(codes.tolist(), counts.tolist(), strict=True))
    assert np.allclose(s.bundle(codes, counts), want)


def labelled(rng, n):
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 200))]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zblokko", "qwuggel", "vyxxer"])
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + " |" for w in words]
        rows.append((i, " ".join(words), int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def marked():
    return labelled(random.Random(10), 600)


def test_toxicity(spark, marked):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in marked] + [(700, None), (701, ""), (0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in marked] + [(1, None), (2, 7), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.predict(docs.where("doc_id > 0").withColumn("predicted", F.lit("x")), model).collect()}
    held = [(i, x) for i, _, _, x in marked if i % 5 == 0 and i]
    assert sum(got[i].predicted == x for i, x in held) / len(held) > 0.95
    assert got[700].score == got[701].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    empty = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert empty.score("anything") == 0.5
    one = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert 0 < one.score("anything") < 0.5


def test_quality(spark, marked):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in marked] + [(700, None), (701, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in marked] + [(1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert 0 < len(model.rules) < 100
    rows = quality.predict(docs.withColumn("score", F.lit("x")), model).collect()
    got = {r.doc_id: r for r in rows}
    held = [(i, q) for i, _, q, _ in marked if i % 3 == 1]
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.95
    texts = {r.doc_id: r.text for r in rows}
    assert np.allclose([got[i].score for i in texts], model.score(list(texts.values())))
    assert got[700].score == got[701].score
    assert quality.train(docs, labels.limit(0), F.lit(True)).score(["x"])[0] == 0.5


@pytest.mark.parametrize("text", [*ODD, None])
def test_statistics_are_finite(text):
    assert len(quality.statistics(text)) == len(quality.STATISTICS) and np.isfinite(quality.statistics(text)).all()


def test_odd_rows_everywhere(odd):
    model = toxicity.fit([], [])
    for out in (toxicity.predict(odd, model), quality.predict(odd, quality.fit(np.zeros((0, 19)), np.zeros(0))), langid.predict(odd, {})):
        assert out.count() == len(ROWS)


def test_toxicity_learns_from_whole_texts(spark):
    """Of a long text every n-gram is learned from, and training in the cluster equals fit()."""
    filler = "calm words about rivers and hills " * 1500
    texts = [filler[:30_000 + i] + (f" vilezzword{i % 2} " if i % 2 else " kindly ") + filler[:20_000] for i in range(16)] + [None, ""]
    labels = [i % 2 for i in range(18)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model, plain = toxicity.train(docs, marks, F.lit(True)), toxicity.fit(texts, labels)
    assert model.score("a vilezzword1 here") > 0.5 > model.score("a kindly word here")
    assert model.bias == pytest.approx(plain.bias) and np.allclose(model.weights, plain.weights)
