"""Khmer-script corpora derived from the documents table, in Spark and in DuckDB's SQL.

km_clean spells each Latin letter as a consonant, so a letter is a cluster;
km_marks turns some letters into vowels, signs and COENG, which gives clusters
of every shape, well-formed or not. A gold line is a sentence's words, a raw line
the same without spaces; the lexicon counts the words of the training lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordlattice.functions import columns as fn
from wordlattice.operators import prep
from wordlattice.sources.lexicon import ALPHA, Lexicon, build

LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CLEAN = "".join(chr(0x1780 + i) for i in range(26)) * 2
_MARKS = {"a": 0x17B6, "e": 0x17C1, "i": 0x17B7, "o": 0x17C4, "u": 0x17BB, "h": 0x17D2, "r": 0x179A, "y": 0x17C9, "x": 0x17B4, "w": 0x17C6, "q": 0x17CC}
MARKS = "".join(chr(_MARKS.get(c, 0x1780 + i)) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")) * 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent, s)"""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "[.\n]")).alias("sent", "s"))


#: Bytes of texts that are cut at once, if not one text has more.
PART_CHARS = 300_000
_FIRST, _LAST = 0x1780, 0x17DD
_SENTENCE = pa.struct([("sent", pa.int32()), ("words", pa.list_(pa.string()))])


def _table(alphabet: str) -> np.ndarray:
    """What each code point becomes: a Khmer one, 1 between sentences, or 0 between words; the last one stands for all that follow."""
    table = np.zeros(_LAST + 2, np.uint32)
    table[_FIRST : _LAST + 1] = np.arange(_FIRST, _LAST + 1)
    table[[ord(c) for c in LATIN]] = [ord(c) for c in alphabet]
    table[[ord(c) for c in ".\n"]] = 1
    return table


def _cut(texts: list[bytes | None], table: np.ndarray) -> pa.Array:
    """(sent, words) of the sentences with words of each text."""
    plain = [(t or b"").decode("utf-8", "replace") for t in texts]
    bounds = np.cumsum([0, *map(len, plain)])
    raw = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
    points = table[np.minimum(raw, len(table) - 1)]
    letter = points > 1
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = bounds[:-1][bounds[:-1] < len(raw)]
    begins[first] = letter[first]
    start = np.flatnonzero(begins)
    # all of these letters have three bytes
    kept, place = points[letter], np.cumsum(letter)
    data = np.empty((len(kept), 3), np.uint8)
    for i, c in enumerate((0xE0 | kept >> 12, 0x80 | (kept >> 6 & 0x3F), 0x80 | (kept & 0x3F))):
        data[:, i] = c
    offsets = np.append(place[start] - 1, len(kept)).astype(np.int32) * 3
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
    ends = np.flatnonzero(points == 1)
    text = np.searchsorted(bounds, start, side="right") - 1
    sent = np.searchsorted(ends, start) - np.searchsorted(ends, bounds)[text]
    new = np.flatnonzero(np.append(True, (np.diff(text) > 0) | (np.diff(sent) > 0))[: len(start)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(start)).astype(np.int32)), words)
    rows = pa.StructArray.from_arrays([pa.array(sent[new].astype(np.int32)), lists], fields=list(_SENTENCE))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(len(texts) + 1)).astype(np.int32)), rows)


def gold(spark: SparkSession, sf_dir: str, alphabet: str = CLEAN) -> DataFrame:
    """(doc_id, sent, words) of lines with words.

    What translate(), split() and regexp_replace() give for each line, made for many texts at once.
    """
    table = _table(alphabet)

    @F.arrow_udf("array<struct<sent:int,words:array<string>>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            part, size = [], 0
            for i in range(0, len(texts), 100):
                for t in texts[i : i + 100].cast(pa.binary()).to_pylist():
                    if part and size + len(t or b"") > PART_CHARS:
                        yield _cut(part, table)
                        part, size = [], 0
                    part.append(t)
                    size += len(t or b"")
            yield _cut(part, table)

    rows = documents(spark, sf_dir).select("doc_id", F.explode(cut("text")).alias("s"))
    return rows.select("doc_id", "s.sent", "s.words")


def raw(spark: SparkSession, sf_dir: str, alphabet: str = CLEAN) -> DataFrame:
    """(doc_id, sent, text)"""
    return gold(spark, sf_dir, alphabet).select("doc_id", "sent", fn.join_words(F.col("words")).alias("text"))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold lines of the training part."""
    lines = gold(spark, sf_dir).withColumn("line", F.array_join("words", " "))
    return prep.hash_split(lines, "line").where("part = 'train'")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, word, value) of the training words."""
    return prep.gold_word_counts(train(spark, sf_dir)).select(F.lit(0).cast("long").alias("line"), "word", F.col("count").cast("double").alias("value"))


@lru_cache(8)
def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The training words' lexicon; its entries are kept for the queries that share it."""
    return build(counts(spark, sf_dir), keep=True)


# -- the same in SQL -------------------------------------------------------------------------


def gold_sql(alphabet: str = CLEAN) -> str:
    return f"""
sentences AS MATERIALIZED (SELECT doc_id, unnest(range(len(parts)))::INT AS sent, unnest(parts) AS s
  FROM (SELECT doc_id, string_split_regex(text, '[.\\n]') AS parts FROM documents)),
gold AS MATERIALIZED (SELECT * FROM (SELECT doc_id, sent, list_filter(string_split(regexp_replace(translate(s, '{LATIN}', '{alphabet}'), '[^\\x{{1780}}-\\x{{17DD}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM sentences) WHERE len(words) > 0),
raw AS MATERIALIZED (SELECT doc_id, sent, array_to_string(words, '') AS text FROM gold)"""


def bucket_sql(text: str, buckets: int) -> str:
    digits = f"list_transform(regexp_extract_all(sha1({text}), '[0-9a-f]{{5}}'), lambda d: ('0x' || d)::BIGINT)"
    return f"list_reduce({digits}, lambda a, d: (a * 1048576 + d) % {buckets}, 0::BIGINT)"


def lexicon_sql(alpha: float = ALPHA) -> str:
    """After gold_sql(): training words with costs."""
    return f"""
split AS (SELECT *, array_to_string(words, ' ') AS line FROM gold),
train AS MATERIALIZED (SELECT * FROM split WHERE {bucket_sql("line", 100)} >= 10),
counts AS MATERIALIZED (SELECT word, count(*)::DOUBLE AS count FROM (SELECT unnest(words) AS word FROM train) GROUP BY word),
totals AS (SELECT sum(count) AS total, count(*) AS size FROM counts),
lexicon AS MATERIALIZED (SELECT word, count, -ln((count + {alpha}) / (total + {alpha} * size)) AS cost FROM counts, totals)"""


#: After lexicon_sql(): every span of a raw line that is a word; a letter is a cluster there.
EDGES_SQL = """
places AS (SELECT doc_id, sent, text, unnest(range(length(text)))::INT AS f FROM raw),
spans AS (SELECT doc_id, sent, f, f + l AS t, substr(text, f + 1, l) AS word
  FROM places, (SELECT unnest(range(1, (SELECT max(length(word)) FROM lexicon) + 1))::INT AS l) WHERE f + l <= length(text)),
edges AS (SELECT doc_id, sent, f, t, cost FROM spans JOIN lexicon USING (word))"""


def walk_sql(backward: bool = False, name: str = "walk") -> str:
    """After EDGES_SQL: the maximal-matching path of each line, with merged unknowns, and its score."""
    at, best = ("t", "min(f)") if backward else ("f", "max(t)")
    length = "k - to_" if backward else "to_ - k"
    order = "list_reverse(range(1, length(text) + 1))" if backward else "range(length(text))"
    piece = "substr(text, to_ + 1, k - to_)" if backward else "substr(text, k + 1, to_ - k)"
    single = "substr(text, k, 1)" if backward else "substr(text, k + 1, 1)"
    shown = f"CASE WHEN to_ IS NULL THEN {single} ELSE ' ' || {piece} || ' ' END"
    start = "length(text)" if backward else "0"
    # state: place, text so far, pieces, unknown ones, one-cluster words
    return f"""
{name}_best AS (SELECT doc_id, sent, {at} AS k, {best} AS to_ FROM edges GROUP BY ALL),
{name}_steps AS (SELECT p.doc_id, p.sent, list({{'k': p.k, 'to_': coalesce(b.to_, {"p.k - 1" if backward else "p.k + 1"}), 'unk': b.to_ IS NULL, 'out': {shown.replace("to_", "b.to_").replace("k", "p.k")}}} ORDER BY {"-" if backward else ""}p.k) AS steps, any_value({start}) AS first
  FROM (SELECT doc_id, sent, text, unnest({order})::INT AS k FROM raw) p LEFT JOIN {name}_best b USING (doc_id, sent, k) GROUP BY p.doc_id, p.sent),
{name}_end AS (SELECT doc_id, sent, list_reduce(steps, lambda s, x: CASE WHEN s.a = x.k THEN {{'a': x.to_, 'o': {"x.out || s.o" if backward else "s.o || x.out"}, 'n': s.n + 1, 'u': s.u + x.unk::INT, 'w': s.w + (NOT x.unk AND abs(x.to_ - x.k) = 1)::INT}} ELSE s END, {{'a': first, 'o': '', 'n': 0, 'u': 0, 'w': 0}}) AS s FROM {name}_steps),
{name} AS (SELECT doc_id, sent, trim(regexp_replace(s.o, ' +', ' ', 'g')) AS segmented, s.n AS n, s.u AS u, s.w AS w FROM {name}_end)"""


#: After EDGES_SQL: the cheapest path of each line, by the order in which edges are met, with merged unknowns.
VITERBI_SQL = """
met AS (SELECT doc_id, sent, f, t, cost, false AS unk FROM edges
  UNION ALL SELECT doc_id, sent, f, f + 1, (SELECT max(cost) + 1 FROM lexicon), true FROM places),
arriving AS (SELECT doc_id, sent, t, list({'f': f, 'cost': cost, 'unk': unk} ORDER BY f, unk) AS es FROM met GROUP BY doc_id, sent, t),
boundaries AS (SELECT doc_id, sent, list(es ORDER BY t) AS bs FROM arriving GROUP BY doc_id, sent),
tables AS (SELECT doc_id, sent, list_reduce(bs, lambda s, es: list_append(s,
  list_reduce(list_transform(es, lambda e: {'c': s[e.f + 1].c + e.cost, 'n': s[e.f + 1].n + 1, 'f': e.f, 'unk': e.unk}),
    lambda b, x: CASE WHEN x.c < b.c - 1e-9 OR (x.c <= b.c + 1e-9 AND x.n < b.n) THEN x ELSE b END)),
  [{'c': 0.0::DOUBLE, 'n': 0, 'f': -1, 'unk': false}]) AS cells FROM boundaries),
traced AS (SELECT doc_id, sent, text, list_reduce(list_reverse(range(1, len(cells))), lambda s, k: CASE WHEN s.a = k THEN
  {'a': cells[k + 1].f::BIGINT, 'o': CASE WHEN cells[k + 1].unk THEN substr(text, k, 1) ELSE ' ' || substr(text, cells[k + 1].f + 1, k - cells[k + 1].f) || ' ' END || s.o} ELSE s END,
  {'a': len(cells)::BIGINT - 1, 'o': ''}) AS s FROM tables JOIN raw USING (doc_id, sent)),
cheapest AS (SELECT doc_id, sent, trim(regexp_replace(s.o, ' +', ' ', 'g')) AS segmented FROM traced)"""
