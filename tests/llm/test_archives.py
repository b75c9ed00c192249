"""ARC conversion and token files: exact round trips."""

import glob
import gzip
import hashlib
import io
import json
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordlattice.llm import arc, tokenfile


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a.example/x y", "19990102030405", "text/html", b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\n<p>\n\n1 2 3\n"), ("http://b.example/", "20010101000000", "text/plain", b""), (None, "bad", "-", b"\n\nno header http://x 1 2 3\n")]
    got = list(arc.read_arc(arc.arc_file(version, records)))
    assert [r.block for r in got] == [b for *_, b in records]
    assert [r.fields["url"] for r in got] == ["http://a.example/x%20y", "http://b.example/", "-"]
    assert [r.fields["date"] for r in got] == [d for _, d, _, _ in records]
    assert all(set(r.fields) == set(arc._V1 if version == 1 else arc._V2) for r in got)


def test_arc_with_blanks_in_urls_and_errors():
    info = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    head = b"filedesc://a.arc 0.0.0.0 19990101000000 text/plain %d\n" % len(info) + info + b"\n"
    data = head + b"http://a/b c d 1.2.3.4 19990102030405 text/html 3\nabc\n\n"
    assert [(r.fields["url"], r.block) for r in arc.read_arc(data)] == [("http://a/b c d", b"abc")]
    for bad in (b"http://a 1.2.3.4 x text/html 9\nabc", head + b"http://a 1.2.3.4 x text/html 99\nabc", head + b"http://a text/html 3\nabc", head[:20]):
        with pytest.raises(ValueError):
            list(arc.read_arc(bad))


@pytest.mark.parametrize("page", [0, 1, 65535, 65536, 2**63 - 1, -1, -(2**63), None])
def test_record_ids_hold_the_page(page):
    rid = arc.record_id(page, b"seed")
    assert arc.page_of(f"<urn:uuid:{rid}>") == page
    assert rid[14] == "8" and rid[19] in "89ab"


def test_warc_record_fields():
    record = arc.ArcRecord({"url": "http://a/", "ip": "1.2.3.4", "date": "19990102030405", "type": "text/html", "length": "9"}, arc.http(7, b"payload\r\n\r\nx"))
    chunks = [arc.to_warc(record) + b"\r\n\r\n" + arc.to_warc(record, 3) + b"\r\n\r\n"]
    for size in (1, 7, 10_000):
        data = chunks[0]
        (one, block), (two, rest) = arc.read_warc(data[i : i + size] for i in range(0, len(data), size))
        assert one["warc-type"] == "response" and one["warc-date"] == "1999-01-02T03:04:05Z" and one["warc-target-uri"] == "http://a/"
        assert block == record.block and arc.page_of(one["warc-record-id"]) == 7
        assert two["warc-type"] == "revisit" and arc.page_of(two["warc-refers-to"]) == 3 and rest.endswith(b"\r\n\r\n") and b"payload" not in rest
        assert one["warc-payload-digest"] == two["warc-payload-digest"] == "sha1:" + arc.digest(b"payload\r\n\r\nx")
    with pytest.raises(ValueError):
        list(arc.read_warc([chunks[0][:-40]]))


PAGES = [(5, "http://a", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://b c\n", "<p>x</p>"), (1, "u", None), (2, "u", ""), (4, "u", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u", "é\U0001f600" * 3000), (6, "u", "é\U0001f600" * 3000), (None, "u", "<p>x</p>"), (None, "u", "only"), (7, "u", "\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_pages(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("payload_bytes", F.lit(2)).repartition(3)
    path = str(tmp_path / "warc")
    got = arc.round_trip(df, path, least_bytes=least).collect()
    first = {}
    for page, _, html in PAGES:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, _, html in PAGES:
        data, to = (html or "").encode(), first.get(html or "")
        revisit = len(data) >= least and to is not None and to != page
        want.append((page, len(data), arc.digest(data), "revisit" if revisit else "response", to if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    files = glob.glob(path + "/part-*")
    assert files and all(gzip.open(f).read(9) in (b"WARC/1.0\r", b"") for f in files)
    assert arc.round_trip(df.limit(0)).collect() == []


def test_gzip_members():
    data = gzip.compress(b"a" * 300_000) + gzip.compress(b"b" * 10) + gzip.compress(b"")
    assert b"".join(arc._inflated(data)) == b"a" * 300_000 + b"b" * 10


# -- token files -------------------------------------------------------------------------------

DOCS = [(i * 7 % 101 - 5, t) for i, t in enumerate(["Hello, World!", "", None, "a\tb\n\nc d", "don't STOP Éé", "日本語 \U0001f600", "x" * 3000, " ", "many words " * 30_000, "<|endoftext|> a", "é é ́x", "ΑΣ ΣΑΣ.", "İI ß"])] + [(500, "twin"), (500, "twin"), (500, "other"), (None, "no id")]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_word_bpe_equals_library(library):
    from tests.test_text import noise

    texts = [t for _, t in DOCS] + noise(300, 12) + ["a\x1cb", "a\x85b c d", "ＡKﬁ"]
    got = tokenfile.word_bpe(public_tokenizers.path(tokenfile.VOCABULARY)).encode(texts)
    assert [g.tolist() for g in got] == [library(t) for t in texts]


def test_words_that_are_joined_for_the_library(library, tmp_path):
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyzABCÀÉßþÿªºµ")
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(3 * tokenfile.JOINED + 7)]
    texts = [" ".join(words), "a\u0301b cd " + words[3], "s t re", "it's " + words[5] + "'s"]
    path = public_tokenizers.path(tokenfile.VOCABULARY)
    own = tokenfile.WordBPE(path)
    assert own.by_stretch
    assert [g.tolist() for g in own.encode(texts)] == [library(t) for t in texts]
    with open(path, encoding="utf-8") as f:
        other = json.load(f)
    other["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    plain = Tokenizer.from_file(str(tmp_path / "other.json"))
    plain.encode_special_tokens = True
    own = tokenfile.WordBPE(str(tmp_path / "other.json"))
    assert not own.by_stretch
    assert [g.tolist() for g in own.encode([*texts, None])] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, ""]]


def counted(monkeypatch):
    """An encoder, and the stretches that its library is given."""
    own, given = tokenfile.WordBPE(public_tokenizers.path(tokenfile.VOCABULARY)), []
    batch = own._batch
    monkeypatch.setattr(own, "_batch", lambda texts: given.extend(p for t in texts for p in t.split(" ")) or batch(texts))
    return own, given


def test_often_met_stretches_stay_remembered(monkeypatch, library):
    monkeypatch.setattr(tokenfile, "MEMO", 200)
    own, given = counted(monkeypatch)
    often = " ".join(f"often{chr(97 + i)}" for i in range(20))
    own.encode([often] * 50)
    for k in range(5):
        own.encode([" ".join(f"{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150))])
    given.clear()
    assert own.encode([often])[0].tolist() == library(often) and given == []


def test_marks_after_known_words_need_no_library(monkeypatch, library):
    own, given = counted(monkeypatch)
    own.encode(["word caf\u00e9 7 *** !! ), . ,"])
    given.clear()
    text = "word*** caf\u00e9, 7), Word. caf\u00e9!! caf\u00e9. word), CAF\u00c9***"
    assert own.encode([text])[0].tolist() == library(text) and given == []
    # what looks like it, but isn't
    texts = ["it's' a'' ''s 's! x'S. \u00b2! \u00bd, \u00aa. e\u0301. \u0437. <|endoftext|>. <|endoftext|>a. a<|b|>, <! \u00a0. a\u00a0.", "a.\u0301 a<\u0338 \u0301. A\u030a, |. a|. a|", "***", "'", "x\x85. \u212b. \u03a3. \u0130."]
    assert [g.tolist() for g in own.encode(texts)] == [library(t) for t in texts]


@pytest.mark.parametrize(("memo", "ids", "taken"), [(10, 1 << 22, 3), (100, 50, 1 << 16), (100, 5000, 7)])
def test_a_full_memory_changes_no_ids(monkeypatch, library, memo, ids, taken):
    from tests.test_text import noise

    for name, value in ("MEMO", memo), ("MEMO_IDS", ids), ("TAKEN", taken), ("JOINED", 4):
        monkeypatch.setattr(tokenfile, name, value)
    own = tokenfile.WordBPE(public_tokenizers.path(tokenfile.VOCABULARY))
    texts = [t for _, t in DOCS if len(t or "") < 9000] + noise(200, 12) + ["abc, def. abc*** ghi " * 3, "y" * 900]
    for end in (2, 7):
        for i in range(0, len(texts), 5):
            assert [g.tolist() for g in own.encode(texts[i : i + 5], end)] == [[*library(t)[:-1], end] for t in texts[i : i + 5]]
        assert own.encode([]) == []


def test_a_failed_call_leaves_no_stretch_without_ids(monkeypatch, library):
    own = tokenfile.WordBPE(public_tokenizers.path(tokenfile.VOCABULARY))
    own.encode(["known words"])
    batch = own._batch
    monkeypatch.setattr(own, "_batch", lambda texts: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        own.encode(["unknown words"])
    monkeypatch.setattr(own, "_batch", batch)
    texts = ["unknown words", "KNOWN\u2028e\u0301 words."]
    assert [g.tolist() for g in own.encode(texts)] == [library(t) for t in texts]


def test_other_added_tokens_get_whole_texts(tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    t.add_tokens(["two words", "ab."])
    t.save(str(tmp_path / "more.json"))
    texts = ["see two words here", "ab. cab."]
    own = tokenfile.WordBPE(str(tmp_path / "more.json"), special=True)
    assert [g.tolist() for g in own.encode(texts)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("size", [tokenfile.FILE_BYTES, 3000])
def test_token_files(spark, tmp_path, monkeypatch, library, size):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", size)
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(4)
    path = str(tmp_path / "ids")
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.round_trip(df, path=path).collect()))
    start = 0
    for at, (begin, doc, n, crc) in enumerate(got):
        assert begin == start
        start += n
        if at:
            assert got[at - 1][1] is None or got[at - 1][1] <= doc
        assert any(i == doc and (ids := library(t)) and len(ids) == n and zlib.crc32(struct.pack(f"<{n}I", *ids)) == crc for i, t in DOCS)
    assert sorted(str(g[1]) for g in got) == sorted(str(i) for i, _ in DOCS)
    files = [f for f in glob.glob(path + "/part-*") if f.endswith(".txt")]
    # any zstandard reader reads the files: data frames only, as all else is skippable
    total = 0
    for f in files:
        with open(f, "rb") as h:
            data = h.read()
        if data:
            total += len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read())
            assert data.endswith(b"\xb1\xea\x92\x8f")
    assert total == 4 * start
    assert tokenfile.round_trip(df.limit(0)).collect() == []


SPECIAL = ["end <|endoftext|> of", "<|startoftext|>a<|endoftext|>", "END <|ENDOFTEXT|> Of <|EndOfText|>.", "é<|endoftext|>É, <|endoftext|>.", "<|endoftext|", "A <|\n|> B", "<|endoftext|>\u0301 x", None, "Plain Text."]


def test_special_tokens_by_the_library_default(spark, tmp_path):
    """op9_token_files encodes as the library does with add_special_tokens=False only."""
    from wordlattice.llm.queries import op9_token_files

    t = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in SPECIAL]
    assert want[0] == [806, 49407, 539, 2] and 49407 not in want[2]
    spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for r, ids in zip(op9_token_files(spark, str(tmp_path)).orderBy("doc_id").collect(), want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def file_of(documents):
    rows = list(tokenfile.frames(documents))
    return b"".join(r + tokenfile._SEEKABLE for r in rows)


def test_reader_opens_only_needed_frames(monkeypatch):
    rng = np.random.default_rng(1)
    documents = [(i, rng.integers(0, 49_000, n).astype("<u4")) for i, n in enumerate([3, 70_000, 1, 65_536, 200_000, 5, 1])]
    data = file_of(documents)

    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    f = Counting(data)
    r = tokenfile.Reader(f)
    assert all((r.ids(i) == ids).all() for i, ids in documents)
    assert [int(d["doc_id"]) for d in r.documents] == list(range(7))
    f = Counting(data)
    r = tokenfile.Reader(f)
    assert r.ids(0).tolist() == documents[0][1].tolist() and f.got < len(data) // 3


def test_damage_is_found():
    data = bytearray(file_of([(1, np.arange(1000, dtype="<u4"))]))
    data[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.Reader(io.BytesIO(bytes(data))).ids(0)
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(b"x" * 100))
    assert len(tokenfile.Reader(io.BytesIO(b"")).documents) == 0


def test_digest():
    assert arc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
