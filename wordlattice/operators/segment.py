"""Segmentation of a text column into tokens.

A line needs nothing but its own text and the lexicon, so the whole operator is
one projection: no shuffle, any partitioning, batch or stream alike. Its kernel
is an Arrow function with the lexicon broadcast. With a lexicon too large for
that, ``segment`` takes the paths of ``native.segment_runs``, which shuffles, and
builds the same tokens from them; this needs a whole DataFrame, so streams, the
SQL function and ``Segmenter`` are bound to BROADCAST_ENTRIES.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordlattice.functions import charsets as cs
from wordlattice.functions import columns as fn
from wordlattice.functions import kernels
from wordlattice.operators import native
from wordlattice.operators.decode import ALGORITHMS, Decoder, Piece
from wordlattice.sources.lexicon import Lexicon

#: Entries of a lexicon that is broadcast, at most (some 85 bytes each in a Python worker).
BROADCAST_ENTRIES = 4_000_000
#: Entries that the driver is sent at once.
AT_ONCE = 400_000
#: Code points that are searched and turned into tokens at once, if not one text has more.
PART_CHARS = 100_000

TOKEN = T.StructType(
    [T.StructField("text", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("start", "end", "byte_start", "byte_end")] + [T.StructField("type", T.StringType()), T.StructField("entry", T.LongType())]
)
_ARROW = pa.struct([("text", pa.string()), *((n, pa.int32()) for n in ("start", "end", "byte_start", "byte_end")), ("type", pa.string()), ("entry", pa.int64())])


@dataclass(frozen=True)
class Options:
    """How to segment: unknown_cost None takes the lexicon's."""

    algorithm: str = "viterbi"
    unknown_cost: float | None = None
    merge_unknown: bool = True
    attach_lektoo: bool = False
    normalize: bool = True

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")


def _looked_up(run: str, options: Options) -> list[str]:
    """Clusters of a run as they are looked up; one code point is canonical."""
    clusters = kernels.clusters(run)
    return list(map(kernels.normalize_cluster, clusters)) if options.normalize and len(clusters) < len(run) else clusters


def _parts(texts: pa.Array):
    """Bounds of stretches of an array with PART_CHARS code points each, about."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    begin = 0
    while begin < len(texts):
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + PART_CHARS, side="right")))
        yield begin, end
        begin = end


def paths_of(texts: list[str | None], decoder: Decoder, options: Options) -> dict[str, list[Piece]]:
    """Paths of all Khmer runs of some texts, searched together."""
    runs = list({token for text in texts if text is not None for token, kind in kernels.pretokenize(text) if kind == "khmer"})
    return dict(zip(runs, decoder.many([_looked_up(r, options) for r in runs]), strict=True)) if runs else {}


def tokens_of(text: str, decoder: Decoder | None, options: Options = Options(), paths: dict[str, list[Piece]] | None = None) -> list[tuple[int, int, str, int | None]]:
    """(start, end, type, entry) of a text's tokens, by a decoder or the paths of its Khmer runs; without either these stay whole."""
    out: list[list] = []
    place = 0
    for token, kind in kernels.pretokenize(text):
        if kind == "khmer" and (decoder is not None or paths is not None):
            clusters = kernels.clusters(token)
            plain = len(clusters) == len(token)
            pieces = paths[token] if paths is not None else decoder.pieces(_looked_up(token, options))
            for a, b, entry in pieces:
                size = b - a if plain else sum(map(len, clusters[a:b]))
                kind = "unknown" if entry is None else "word"
                last = out[-1] if out else None
                if entry is None and options.merge_unknown and last and last[2] == "unknown" and last[1] == place:
                    last[1] = place + size
                else:
                    out.append([place, place + size, kind, entry])
                place += size
            continue
        end = place + len(token)
        if token == cs.LEK_TOO and options.attach_lektoo and out and out[-1][2] in cs.KHMER_TYPES and out[-1][1] == place:
            out[-1][1] = end
        else:
            out.append([place, end, kind, None])
        place = end
    return out


def _batch(texts: list[str | None], decoder: Decoder | None, options: Options, paths: list[dict] | None = None) -> pa.Array:
    """Tokens of a batch, built column by column; ``paths`` has those of each text's runs."""
    found = paths_of(texts, decoder, options) if decoder is not None else None
    offsets, words, types, entries = [0], [], [], []
    starts, ends, byte_starts, byte_ends, missing = [], [], [], [], []
    for i, text in enumerate(texts):
        if text is not None:
            byte = 0
            for start, end, kind, entry in tokens_of(text, None, options, paths[i] if paths is not None else found):
                word = text[start:end]
                size = len(word) if word.isascii() else len(word.encode())
                words.append(word)
                starts.append(start)
                ends.append(end)
                byte_starts.append(byte)
                byte += size
                byte_ends.append(byte)
                types.append(kind)
                entries.append(entry)
        missing.append(text is None)
        offsets.append(len(words))
    columns = [pa.array(words, pa.string()), *(pa.array(x, pa.int32()) for x in (starts, ends, byte_starts, byte_ends)), pa.array(types, pa.string()), pa.array(entries, pa.int64())]
    values = pa.StructArray.from_arrays(columns, fields=list(_ARROW))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(missing))


def fits(lexicon: Lexicon) -> bool:
    """Is a lexicon small enough to be broadcast?"""
    return lexicon.entries.count() <= BROADCAST_ENTRIES


def unknown_cost(lexicon: Lexicon, options: Options) -> float:
    return lexicon.meta.unknown_cost if options.unknown_cost is None else options.unknown_cost


def decoder_of(spark: SparkSession, lexicon: Lexicon | None, options: Options):
    """A broadcast Decoder, or None without a lexicon."""
    if lexicon is None:
        return None
    size = lexicon.entries.count()
    if size > BROADCAST_ENTRIES:
        raise ValueError(f"more than {BROADCAST_ENTRIES} entries are too many to broadcast; use segment() on a batch DataFrame")
    parts = max(1, -(-size // AT_ONCE))

    def batches():
        for i in range(parts):
            rows = lexicon.entries.where(F.pmod("entry", F.lit(parts)) == i).select("word", "entry", "cost").toArrow()
            for chunk in rows.to_batches(max_chunksize=50_000):
                yield chunk.column(0).to_pylist(), chunk.column(1).to_numpy(), chunk.column(2).to_numpy()

    return spark.sparkContext.broadcast(Decoder.of_batches(batches(), unknown_cost(lexicon, options), options.algorithm))


def tokenizer(spark: SparkSession, lexicon: Lexicon | None = None, options: Options = Options(), shared=None):
    """A function Column -> Column of tokens, which also works in SQL and on streams; ``shared`` is a decoder_of() that is broadcast already."""
    shared = shared or decoder_of(spark, lexicon, options)

    @F.arrow_udf(T.ArrayType(TOKEN))
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = shared.value if shared else None
        for texts in batches:
            if not len(texts):
                yield _batch([], None, options)
            for a, b in _parts(texts):
                yield _batch(texts[a:b].to_pylist(), decoder, options)

    return tokens


def _joined(df: DataFrame, lexicon: Lexicon, options: Options, text_col: str, out_col: str) -> DataFrame:
    """segment() by lattice joins: the lexicon is never held in one place.

    Texts and runs are keyed by their SHA-256, so that exploded rows don't drag
    them along, and a run that many texts share is searched once.
    """
    text = F.col(text_col)
    parts = native.runs(df, text_col, options.normalize).select(F.sha2("run", 256).alias("__run"), "parts")
    paths = native.segment_runs(parts, lexicon.entries, lexicon.meta.max_clusters, unknown_cost(lexicon, options), options.algorithm, "__run")
    khmer = F.transform(F.filter(fn.pretokenize(text), lambda t: t["type"] == "khmer"), lambda t: t["text"])
    places = df.select(F.sha2(text, 256).alias("__key"), F.explode(khmer).alias("run")).distinct().withColumn("__run", F.sha2("run", 256))
    found = places.join(paths, "__run").groupBy("__key").agg(F.collect_list(F.struct("run", "path")).alias("__paths"))  # one text's runs

    @F.arrow_udf(T.ArrayType(TOKEN))
    def tokens(texts: pa.Array, known: pa.Array) -> pa.Array:
        by_run = [{r["run"]: [(p["from"], p["to"], p["entry"]) for p in r["path"]] for r in row or ()} for row in known.to_pylist()]
        return _batch(texts.to_pylist(), None, options, by_run)

    rows = df.withColumn("__key", F.sha2(text, 256)).join(found, "__key", "left")
    return rows.withColumn(out_col, tokens(text, F.col("__paths"))).drop("__key", "__paths")


def segment(df: DataFrame, lexicon: Lexicon | None = None, options: Options = Options(), text_col: str = "text", out_col: str = "tokens", shared=None) -> DataFrame:
    """``df`` with an array of tokens; null texts give null. A lexicon of any size will do unless ``df`` is a stream."""
    if shared is None and lexicon is not None and not df.isStreaming and not fits(lexicon):
        return _joined(df, lexicon, options, text_col, out_col)
    return df.withColumn(out_col, tokenizer(df.sparkSession, lexicon, options, shared)(F.col(text_col)))


def lattice_sums(df: DataFrame, lexicon: Lexicon, *keys: str, unknown_cost: float | None = None, text_col: str = "text") -> DataFrame:
    """(keys, n_edges, n_unknown, cost) of each row's native.lattice(), for texts that are one run; rows without an edge are left out.

    Words are found in the broadcast lexicon, so no span is joined or shuffled; a
    lexicon too large for that is joined.
    """
    unknown = 0.0 if unknown_cost is None else float(unknown_cost)
    if not fits(lexicon):
        parts = df.select(*keys, fn.normalized_clusters(F.col(text_col)).alias("parts"))
        edges = native.lattice(parts, lexicon.entries, lexicon.meta.max_clusters, *keys, unknown_cost=unknown_cost)
        return edges.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.count_if(F.col("entry").isNull()).alias("n_unknown"), F.sum("cost").alias("cost"))
    shared = decoder_of(df.sparkSession, lexicon, Options())
    fields = [pa.field("n_edges", pa.int64()), pa.field("n_unknown", pa.int64()), pa.field("cost", pa.float64())]

    @F.arrow_udf("n_edges long, n_unknown long, cost double")
    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if not len(texts):
                yield pa.array([], pa.struct(fields))
            for a, b in _parts(texts):
                runs = [_looked_up(t or "", Options()) for t in texts[a:b].to_pylist()]
                number, cost = shared.value.sums(runs)
                singles = np.array([len(r) if unknown_cost is not None else 0 for r in runs], np.int64)
                yield pa.StructArray.from_arrays([pa.array(number + singles), pa.array(singles), pa.array(cost + unknown * singles)], fields=fields)

    # else the filter would be pushed below and count all edges once more
    once = sums.asNondeterministic()
    return df.select(*keys, once(F.col(text_col)).alias("s")).select(*keys, "s.*").where("n_edges > 0")


def words(tokens: Column) -> Column:
    """Texts of all tokens but spaces."""
    return F.transform(F.filter(tokens, lambda t: t["type"] != "space"), lambda t: t["text"])


def register(spark: SparkSession, name: str = "tokenize", lexicon: Lexicon | None = None, options: Options = Options()) -> None:
    """Makes the tokenizer a SQL function."""
    spark.udf.register(name, tokenizer(spark, lexicon, options))


class Segmenter:
    """Segmentation of single texts on the driver, for interactive use."""

    def __init__(self, lexicon: Lexicon | None = None, options: Options = Options(), spark: SparkSession | None = None):
        self.options = options
        shared = decoder_of(spark or lexicon.entries.sparkSession, lexicon, options) if lexicon is not None else None
        self.decoder = shared.value if shared else None

    @property
    def unknown_cost(self) -> float | None:
        return self.decoder.unknown_cost if self.decoder else None

    def tokenize(self, text: str) -> list[tuple[str, int, int, str, int | None]]:
        """(text, start, end, type, entry) of all tokens."""
        return [(text[a:b], a, b, kind, entry) for a, b, kind, entry in tokens_of(text, self.decoder, self.options)]

    def segment(self, text: str) -> list[str]:
        """Texts of all tokens but spaces."""
        return [t for t, _, _, kind, _ in self.tokenize(text) if kind != "space"]
