"""The pipeline against a plain-Python version, and the queries over the smallest tables."""

import hashlib
import os

import public_tokenizers
import pytest
import tiktoken

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_pairs import brute  # noqa: E402
from tests.llm.test_texts import plain_spans, plain_words  # noqa: E402
from wordlattice.llm import bpe, pii, queries  # noqa: E402


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mask_pii", "tokenize"]


def test_pipeline_on_made_up_documents(spark, tmp_path):
    passage = "zero one two three four five six seven eight nine ten eleven"
    body = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    texts = {
        1: body, 2: body, 3: body.replace("wordaa", "changed"), 4: "Some other text, written to a.b@c.de about nothing.", 5: f"{body.upper()[:200]} {passage} end of that",
        6: "12 34 !?", 7: "", 8: None, 9: passage, 10: "call +1 (415) 555-0100 or 4111 1111 1111 1111 now please",
    }
    rows = [(i, t, "en", "src", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    _, component = brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i] == i}
    want = {}
    for i, t in kept.items():
        if passage in t:
            if 12 > 0.5 * len(plain_words(t)):
                continue
            t = t.replace(passage, "")
        for kind, s, e in sorted(plain_spans(t), key=lambda x: -x[1]):
            t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
        want[i] = t
    assert sorted(want) == [1, 4, 5, 10] and "[EMAIL]" in want[4] and want[10] == "call [PHONE] or [CARD] now please"

    d = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        d = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert {r.doc_id: r.text for r in d.collect()} == want
    assert all(r.n_chars == len(r.text) for r in d.collect())

    codec = bpe.codec(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(want)
    for i, t in want.items():
        assert got[i].token_ids == library.encode_ordinary(t)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_return_their_columns(spark):
    want = {
        "op1_quality": ["doc_id", "held_out", "score", "predicted"], "op2_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op3_arc_to_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op4_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
        "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op6_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"], "op10_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    }
    assert list(queries.QUERIES) == list(want)
    for name in ("op1_quality", "op7_language_id", "op8_toxicity"):
        df = queries.QUERIES[name](spark, SF)
        assert df.columns == want[name]
        rows = df.collect()
        documents = spark.read.parquet(f"{SF}/documents.parquet")
        assert len(rows) == documents.count()
        if name == "op7_language_id":
            lang = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
            held = [r for r in rows if r.held_out]
            assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_pii_kinds_are_known():
    assert set(pii.BASE) < set(pii.KINDS) == set(pii.CONTEXT)


def test_clash_columns_pass(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, Decoded string")
    assert bpe.decode(bpe.encode(df)).columns == ["doc_id", "text", "token_ids", "decoded"]


def test_language_stage_passes_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(1, "some words", "en", "x", "y"), (2, "123", "en", "x", "y"), (3, None, "en", "x", "y")], "doc_id long, text string, lang string, Lang_pred string, score string")
    out = corpus_pipeline.language_id(spark, df, None)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [(1, "some words", "en", "x", "y")]
