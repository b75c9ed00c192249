"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a sequence of zstandard frames and skippable frames:

* data frames, each with the little-endian unsigned 32-bit ids of some whole
  documents, or of a part of one long document, with zstandard's own checksum;
* one skippable frame (magic 0x184D2A51) with the documents: a null flag, doc_id
  (int64), first id within the file and number of ids (uint64 each);
* the seek table of the zstandard seekable format: for each data frame its
  compressed size, its decompressed size and the low 32 bits of the XXH64 of its
  decompressed data, then the number of frames, a descriptor and the magic.

Spark's text sink writes the frames, as it reaches any store that Spark can
write to. It ends each row with a separator, for which the last four bytes of a
seekable file, its magic, are taken; other frames are followed by the head of a
skippable frame of four bytes, whose content the separator then is. So a file
ends right after its seek table and any zstandard reader can read it.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain, compress, count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordlattice.llm.common import shared_dir

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Ids in a frame, at most.
FRAME_IDS = 1 << 16
#: Text in a file, about.
FILE_BYTES = 32 << 20
LEVEL = 3
#: Words given to the library as one text.
JOINED = 500
#: Distinct stretches between blanks in a worker's memory, and their ids, before a group of texts.
MEMO = 300_000
MEMO_IDS = 1 << 22
#: Stretches whose ids are taken from memory at once.
TAKEN = 1 << 16

# fixed values: the steps of the vocabulary for which texts may be encoded by stretches
_NORMALISER = '{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\\\s+"},"content":" "},{"type":"Lowercase"}]}'
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPECIAL = r"<\|[A-Za-z0-9]+\|>"
# ASCII's marks but the one that special tokens' ends have
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"
_SEEKABLE = b"\xb1\xea\x92\x8f"
_SKIP4 = struct.pack("<II", 0x184D2A50, 4)
_DOCUMENTS = 0x184D2A51
_TABLE = 0x184D2A5E
_DOCUMENT = np.dtype([("null", "<u8"), ("doc_id", "<i8"), ("first", "<u8"), ("count", "<u8")])


class _Memory:
    """Places of stretches, the ids at each place in one pool, and how often each was met.

    A stretch that is looked up in ``places`` and isn't there gets the next place;
    its ids must be added before they are taken. Place 0 is the end id's.
    """

    def __init__(self, stretches=()):
        self.places = defaultdict(count(1 + len(stretches)).__next__, zip(chain([None], stretches), count()))
        self.pool = np.empty(1 << 16, "<u4")
        self.used = 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.add([0], np.zeros(1, "<u4"), np.ones(1, np.int64))

    def add(self, places: list[int] | slice, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps ``ids``, which are those of each of ``places`` in turn."""
        more = len(self.places) - len(self.starts)
        if more > 0:
            more = np.zeros(max(more, len(self.starts) // 2), np.int64)
            self.starts, self.sizes, self.met = (np.concatenate((x, more)) for x in (self.starts, self.sizes, self.met))
        used = self.used + len(ids)
        if used > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(max(used - self.used, len(self.pool) // 2), "<u4")))
        self.pool[self.used : used] = ids
        self.sizes[places] = sizes
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.used = used

    def best(self) -> _Memory:
        """A memory of the stretches met most often, the later ones of equals, up to half of MEMO and of MEMO_IDS; none of very many ids."""
        n = len(self.places)
        order = np.lexsort((np.arange(1, n), self.met[1:n]))[::-1] + 1
        order = order[self.sizes[order] <= MEMO_IDS // 1000][: MEMO // 2]
        order = np.sort(order[np.cumsum(self.sizes[order]) <= MEMO_IDS // 2])
        kept = np.zeros(n, bool)
        kept[order] = True
        out = _Memory(list(compress(self.places, kept.tolist())))
        out.add(slice(1, len(order) + 1), *self.take(order))
        out.met[1 : len(order) + 1] = self.met[order] // 2
        return out

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at ``places`` in turn, and the number of them at each."""
        sizes = self.sizes[places]
        ids, end = np.empty(int(sizes.sum()), "<u4"), 0
        for i in range(0, len(places), TAKEN):
            some = sizes[i : i + TAKEN]
            before = np.cumsum(some) - some
            at = np.repeat(self.starts[places[i : i + TAKEN]] - before, some)
            at += np.arange(len(at))
            ids[end : end + len(at)] = self.pool[at]
            end += len(at)
        return ids, sizes


class WordBPE:
    """The tokenizers library's encoding of a text, remembered for each stretch between blanks.

    No token of this vocabulary spans a blank, and neither its normaliser nor its
    pattern looks beyond one, so a text's ids are those of its stretches in order.
    Strings of special tokens in a text are ordinary text; with ``special`` they
    are those tokens, as by the library's default. A vocabulary with another
    normaliser or pattern, or special tokens of another form, is given whole texts.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.normaliser = self.library.normalizer
        steps = json.loads(self.library.pre_tokenizer.__getstate__()).get("pretokenizers", [{}]) if self.library.pre_tokenizer else [{}]
        known = self.normaliser and json.loads(self.normaliser.__getstate__()) == json.loads(_NORMALISER)
        plain = all(re.fullmatch(_SPECIAL, t.content) and not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in self.library.get_added_tokens_decoder().values())
        self.by_stretch = bool(known) and plain and steps[0].get("pattern") == {"Regex": _PATTERN}
        #: whether a token ends a word
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in self.library.get_vocab(with_added_tokens=True).items() if token.endswith("</w>")]] = True
        self.memory = _Memory()

    def _batch(self, texts: list[str]):
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def _learn(self, known: int) -> None:
        """Brings the ids of the stretches whose places begin at ``known`` into the memory.

        Marks at the end of a stretch, after a letter or digit, are one match of
        the pattern, so such a stretch is put together from the rest and its marks.
        """
        memory, places = self.memory, self.memory.places
        new = list(islice(reversed(places), len(places) - known))[::-1]
        marked, pieces, words, words_at, others, others_at = [], [], [], [], [], []
        for place, part in enumerate(new, known):
            if part.isalpha() and _latin(part):
                words.append(part)
                words_at.append(place)
            elif (rest := part.rstrip(_MARKS)) != part and rest[-1:].isalnum() and rest[-1] < "\u0100":
                marked.append(place)
                for piece in (rest, part[len(rest) :]):
                    pieces.append(places[piece])
                    if pieces[-1] == known + len(new):
                        new.append(piece)
            else:
                others.append(part)
                others_at.append(place)
        # letters below U+0100 alone are one word to the pattern; to the normaliser, lower case is all there is to do
        self.library.normalizer = None
        try:
            for i in range(0, len(words), JOINED):
                some, some_at = words[i : i + JOINED], words_at[i : i + JOINED]
                ids = np.array(self._batch([" ".join(some).lower()])[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(some) and stops[-1] == len(ids):
                    memory.add(some_at, ids, np.diff(stops, prepend=0))
                else:
                    others += some
                    others_at += some_at
        finally:
            self.library.normalizer = self.normaliser
        if others:
            found = [e.ids for e in self._batch(others)]
            memory.add(others_at, np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)))
        if marked:
            ids, sizes = memory.take(np.array(pieces))
            memory.add(marked, ids, sizes.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str | None], end: int = END) -> list[np.ndarray]:
        """Ids of each text with ``end`` appended, as little-endian uint32."""
        if not self.by_stretch:
            return [np.array([*e.ids, end], "<u4") for e in self._batch([t or "" for t in texts])]
        if not texts:
            return []
        if len(self.memory.places) > MEMO or self.memory.used > MEMO_IDS:
            self.memory = self.memory.best()
        memory, rows = self.memory, []
        memory.pool[0] = end
        known, place = len(memory.places), memory.places.__getitem__
        try:
            for text in texts:
                text = text or ""
                # the normaliser would do so; here it makes fewer stretches, but could make special tokens
                if "<|" not in text and _latin(text):
                    text = text.lower()
                parts = text.replace("\n", " ").split(" ")
                parts.append(None)
                rows.append(np.fromiter(map(place, parts), np.int32, len(parts)))
            if len(memory.places) > known:
                self._learn(known)
        except BaseException:
            self.memory = _Memory()  # new stretches have no ids
            raise
        found = np.concatenate(rows)
        ids, sizes = memory.take(found)
        n = len(memory.places)
        memory.met[:n] += np.bincount(found, minlength=n)
        stops = np.cumsum(np.add.reduceat(sizes, np.cumsum([0, *map(len, rows[:-1])]))).tolist()
        return [ids[start:stop] for start, stop in zip([0, *stops], stops)]


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100, where the normaliser's lower case is Python's and nothing is composed."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


@lru_cache(1)
def word_bpe(path: str, special: bool = False) -> WordBPE:
    """One encoder a worker process."""
    return WordBPE(path, special)


def frames(documents):
    """Rows of one file for an iterator of (doc_id, ids): all but the last four bytes of each frame's stretch."""
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
    entries, index, first = [], [], 0
    pending, waiting = [], 0

    def packed(data: bytes) -> bytes:
        row = packer.compress(data) + _SKIP4
        entries.append(struct.pack("<III", len(row) + 4, len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return row

    for doc_id, ids in documents:
        index.append((doc_id is None, doc_id or 0, first, len(ids)))
        first += len(ids)
        if waiting + len(ids) > FRAME_IDS and pending:
            yield packed(b"".join(pending))
            pending, waiting = [], 0
        while len(ids) > FRAME_IDS:
            yield packed(ids[:FRAME_IDS].tobytes())
            ids = ids[FRAME_IDS:]
        pending.append(ids.tobytes())
        waiting += len(ids)
    if not index:
        return
    yield packed(b"".join(pending))
    content = np.array(index, _DOCUMENT).tobytes()
    yield struct.pack("<II", _DOCUMENTS, len(content)) + content + _SKIP4
    table = b"".join(entries) + struct.pack("<IB", len(entries), 0x80)
    yield struct.pack("<II", _TABLE, len(table) + 4) + table


class Reader:
    """Random access to a token file: any object with seek, tell and read."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        if end == 0:
            self.documents = np.zeros(0, _DOCUMENT)
            return
        count, flags, magic = struct.unpack("<IB4s", self._at(end - 9, 9))
        if magic != _SEEKABLE or flags != 0x80:
            raise ValueError("not a token file")
        entries = np.frombuffer(self._at(end - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(entries[:, 0])))
        self.ends = np.cumsum(entries[:, 1]) // 4
        self.sizes, self.checks = entries[:, 1], entries[:, 2]
        magic, size = struct.unpack("<II", self._at(int(self.places[-1]), 8))
        if magic != _DOCUMENTS:
            raise ValueError("the list of documents is missing")
        self.documents = np.frombuffer(self.file.read(size), _DOCUMENT)
        self.unpacker = zstandard.ZstdDecompressor()
        self.held = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        """Decompressed and checked data of a frame."""
        if self.held[0] != k:
            data = self.unpacker.decompress(self._at(int(self.places[k]), int(self.places[k + 1] - self.places[k])), max_output_size=int(self.sizes[k]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            self.held = k, data
        return self.held[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the file's i-th document; only its frames are decompressed."""
        first, count = int(self.documents[i]["first"]), int(self.documents[i]["count"])
        k = int(np.searchsorted(self.ends, first, side="right"))
        out = []
        while count:
            begin = int(self.ends[k - 1]) if k else 0
            data = np.frombuffer(self.frame(k), "<u4")[first - begin :][:count]
            out.append(data)
            first, count, k = first + len(data), count - len(data), k + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, special: bool = False) -> None:
    """Encodes all texts and writes them to files under ``path`` in ascending id order.

    Files follow each other by name, documents within them by id; null ids come
    first and equal ids by their text. A null text is an empty one, which has the
    end id only. An empty table gives files without documents, or none. See
    WordBPE for ``special``.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    # the last key only spreads equal rows over files
    order = "doc_id", "by_text", "place"
    rows = rows.withColumn("by_text", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        encoder = word_bpe(vocabulary, special)

        def documents():
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for i in range(0, len(ids), 256):
                    yield from zip(ids[i : i + 256], encoder.encode(texts[i : i + 256].to_pylist()), strict=True)

        for row in frames(documents()):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["frame"])

    out = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.option("lineSep", _SEEKABLE.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under ``path``.

    start counts the ids of all documents before it, over all files. Each file is
    read by one task, which holds one file and one frame of it.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = Reader(pa.BufferReader(content.as_buffer()))
                d = reader.documents
                ids = pa.array(np.where(d["null"] == 0, d["doc_id"], 0), pa.int64(), mask=d["null"] != 0)
                sums = [zlib.crc32(reader.ids(i).tobytes()) for i in range(len(d))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(d), pa.string()), ids, pa.array(d["first"].astype(np.int64)), pa.array(d["count"].astype(np.int64)), pa.array(sums, pa.int64())], names=["file", "doc_id", "first", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "file string, doc_id long, first long, n_tokens long, ids_crc32 long")

    def sizes(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d = Reader(pa.BufferReader(content.as_buffer())).documents
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(d["count"].sum())], pa.int64())], names=["file", "ids"])

    # one row for each file, which holds tens of MB of text
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.mapInArrow(sizes, "file string, ids long").select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None, special: bool = False) -> DataFrame:
    """Writes the files and reads them back; see write() and read()."""
    path = path or shared_dir(df.sparkSession)
    write(df, path, id_col, text_col, vocabulary, special)
    return read(df.sparkSession, path)
