"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when 100 * |A & B| >= 75 * |A | B|, A and B being their sets of
five-word shingles. All shingles are ordered by estimated frequency, rare ones
first. If a text of n shingles needs k = ceil(0.75 n) common ones, any partner
shares at least l of its first n - k + l shingles. Each text chooses its own l:
a longer prefix costs more index rows, but asks more of a candidate. A pair
must share as many prefix shingles as the smaller l of both, early enough in both
for the sets to have as many in common as they need, and is then verified on the
whole sets, held as 64-bit hashes of their shingles.

Steps, each over all rows:
1. Hash the shingles; count them in a fixed-size sketch. Texts with equal sets
   form a class, of which one goes on.
2. Choose prefixes; index them by shingle. The list of a frequent shingle, as the
   sketch has it, is split into parts by a hash of the text's id.
3. In each part, propose only the pairs of its first member with the others, and
   of the parts' first members with the list's, and of these a member's FIRST
   best; verify; join into components. Groups of near copies, however large,
   collapse here in a number of pairs that is linear in the index.
4. Lists whose members are still in different components are dealt by the
   component of their first member, the lead. Members outside of it, the strays,
   are compared with all members. Where a lead's lists would make few pairs, they
   are joined by shingle. Where they would make many (a large group of near copies
   close to the threshold shares nearly all its lists, so each pair would be made
   once for each list), the texts travel instead: chunks of strays meet chunks of
   members, prefixes are matched as matrices and candidates verified on the spot,
   best first, until a stray is joined with the other's component.
A pair that is left out lies within one component already, so no link can be
missed that would join two.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordlattice.llm.common import BROADCAST_IDS, bounded_batches, components, look_up, only_ids, release, slices, stored

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 20
MOST_MATCHES = 8
#: First members that a text is compared with in step 3; step 4 finds whatever that leaves.
FIRST = 3
#: Cost of verifying a candidate, in index rows.
VERIFY = 20
#: A list is split so that its parts hold about this many members.
PART = 1_000
#: Shingles of the texts that one chunk of step 4 holds, and what a text counts on top of its own.
CHUNK, CHUNK_TEXT = 400_000, 200
#: Cost of a pair of step 4's join, in shingles sent to a chunk.
PAIR = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """The set of a text: its distinct shingles, or all its words if they are fewer than SHINGLE."""
    w = words(text)
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False))


def hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's set."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words(text)), np.uint64)
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + len(h)]) * _ODD
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _needed(n: int) -> int:
    return -(-PERCENT * n // 100)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _links(a: np.ndarray, b: np.ndarray) -> bool:
    common = _common(a, b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def prefix(tokens: np.ndarray, sketch: np.ndarray, floor: float) -> tuple[np.ndarray, int]:
    """The prefix of a set and its l, the least number of shingles to share."""
    estimate = sketch[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((tokens, estimate))
    others = np.maximum(estimate[order] - 1 - floor, 0.0)
    scanned = np.cumsum(others + 1)
    met = np.cumsum(others)
    need = _needed(len(tokens))
    matches = np.arange(1, min(MOST_MATCHES, need) + 1)
    ends = len(tokens) - need + matches
    # at most met/l other texts can share l of these shingles
    best = int((scanned[ends - 1] + VERIFY * met[ends - 1] / matches).argmin())
    return tokens[order[: ends[best]]], best + 1


def parted(tokens: np.ndarray, sketch: np.ndarray, floor: float) -> np.ndarray:
    """Shingles as index keys: the low 6 bits are the logarithm of the number of parts of the shingle's list."""
    excess = sketch[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] - floor
    parts = np.ceil(np.log2(np.maximum(excess / max(PART, floor), 1.0))).astype(np.uint64)
    return (tokens & ~np.uint64(63)) | parts


def _sets(docs: DataFrame) -> DataFrame:
    """For each row (id, n, sig), sig being a digest of its set; and for each task a row with its sketch."""

    def run(batches):
        sketch, pending, waiting = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def flush():
            nonlocal sketch, waiting
            if pending:
                sketch += np.bincount((np.concatenate(pending) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                pending.clear()
                waiting = 0

        for batch in slices(batches):
            counts, digests = [], []
            for text in batch.column(1).to_pylist():
                h = hashes(text)
                counts.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                pending.append(h)
                waiting += len(h)
                if waiting > 1 << 20:
                    flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(counts), pa.binary())], names=["id", "n", "sig", "sketch"])
        flush()
        if sketch.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([zlib.compress(sketch.tobytes(), 1)], pa.binary())], names=["id", "n", "sig", "sketch"])

    return docs.mapInArrow(run, "id long, n long, sig binary, sketch binary")


def _merged(sets: DataFrame):
    """An RDD of the tasks' sketches summed and packed again: one item, or none without sketches.

    Groups of about the square root of the number of tasks are summed first, then
    the groups' sums; so the driver gets one packed sketch, however many tasks ran.
    """

    def total(packed):
        out = None
        for item in packed:
            one = np.frombuffer(zlib.decompress(item), np.int64)
            out = one.copy() if out is None else np.add(out, one, out=out)
        return [] if out is None else [zlib.compress(out.tobytes(), 1)]

    parts = sets.where("sketch is not null").select("sketch").rdd.map(lambda r: bytes(r[0]))
    groups = max(1, int(parts.getNumPartitions() ** 0.5))
    return parts.mapPartitions(total).coalesce(groups, shuffle=True).mapPartitions(total).coalesce(1, shuffle=True).mapPartitions(total)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches: a fixed number of counters, however many rows."""
    found = _merged(sets).collect()
    return np.frombuffer(zlib.decompress(found[0]), np.int64) if found else np.zeros(1 << SKETCH_BITS, np.int64)


def _prefixes(docs: DataFrame, shared) -> DataFrame:
    """One row for each class: (rep, n, l, tokens), rep being its smallest id; ``shared`` is the broadcast sketch and its median."""

    def run(batches):
        counts, floor = shared.value
        for batch in slices(batches):
            ids, out = batch.column(0).to_pylist(), [[], [], [], [], []]
            for key, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                h = hashes(text)
                if key is None or not len(h):
                    continue
                tokens, least = prefix(h, counts, floor)
                keys = parted(tokens, counts, floor).view(np.int64)
                for column, value in zip(out, (key, len(h), least, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), keys), strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["id", "n", "l", "sig", "tokens"])

    rows = docs.mapInArrow(run, "id long, n long, l long, sig binary, tokens array<long>")
    # a class has one n, l and prefix, as they depend on its set alone
    return rows.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("l").alias("l"), F.first("tokens").alias("tokens"))


def _with_texts(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored rows ``assigned`` with the text of their ``id``; broadcast if they are few, else both sides are shuffled."""
    few = assigned.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(assigned) if few else assigned.hint("shuffle_merge"), "id")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of the stored ``pairs`` that link, stored; the text of b travels to that of a, in parts if a has many partners."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    ends = F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("role")), F.struct(F.col("b").alias("id"), F.lit(1).alias("role")))
    assigned = stored(dealt.select("a", "part", F.explode(ends).alias("end")).select("a", "part", "end.id", "end.role").distinct())
    rows = _with_texts(assigned, docs).repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches):
        at, first = None, None
        for batch in slices(batches):
            keys, found = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), []
            for key, role, id_, text in zip(keys, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if role == 0:
                    if key != at:
                        at, first = key, hashes(text)
                elif _links(first, hashes(text)):
                    found.append((key[0], id_))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    out = stored(rows.select("a", "part", "role", "id", "text").mapInArrow(run, "a long, b long"))
    release(assigned)
    return out


def _packed(n, place, least):
    """A prefix shingle's set size, place and the set's l in one long."""
    return F.shiftleft(n, 34) + F.shiftleft(place.cast("long"), 4) + least


def _size(packed):
    return F.shiftright(packed, 34)


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b, shared) from rows (a, b, x, y), one for each shared prefix shingle; x and y are packed, in either order.

    A pair that links needs 75 / 175 of both sizes in common. Of its first l
    shared shingles, none comes so late in either set that fewer are left than
    that, less the l - 1 that may have come before.
    """
    left = lambda c: _size(c) - F.shiftright(c, 4).bitwiseAND((1 << 30) - 1)
    least = F.least(F.col("x").bitwiseAND(15), F.col("y").bitwiseAND(15))
    total = PERCENT * (_size("x") + _size("y"))
    fits = (100 * F.least(_size("x"), _size("y")) >= PERCENT * F.greatest(_size("x"), _size("y"))) & ((100 + PERCENT) * (F.least(left("x"), left("y")) + least - 1) >= total)
    return rows.where(fits).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(least).alias("least")).where("shared >= least").select("a", "b", "shared")


def _listed(classes: DataFrame) -> DataFrame:
    """(token, rep, x, a, first_x), stored: the index without lists of one member; a is the first member of the part that rep is in."""
    index = classes.select("rep", "n", "l", F.posexplode("tokens").alias("place", "token")).select("token", "rep", _packed(F.col("n"), F.col("place"), F.col("l")).alias("x"))
    parts = F.col("token").bitwiseAND(63)
    index = index.withColumn("part", F.xxhash64("rep").bitwiseAND(F.expr("shiftleft(1L, cast(token & 63 as int)) - 1")))
    in_part = Window.partitionBy("token", "part").orderBy(F.xxhash64("rep"), "rep")
    so_far = in_part.rowsBetween(Window.unboundedPreceding, 0)
    listed = index.withColumn("first", F.first(F.struct("rep", "x")).over(so_far)).withColumn("next", F.lead("rep").over(in_part))
    listed = listed.where((F.col("first.rep") != F.col("rep")) | F.col("next").isNotNull() | (parts > 0))
    return stored(listed.select("token", "rep", "x", F.col("first.rep").alias("a"), F.col("first.x").alias("first_x")))


def _star(listed: DataFrame) -> DataFrame:
    """(a, b) of step 3, stored."""
    in_part = listed.where("a <> rep").select("a", F.col("rep").alias("b"), F.col("first_x").alias("x"), F.col("x").alias("y"))
    by_token = Window.partitionBy("token").orderBy(F.xxhash64("rep"), "rep").rowsBetween(Window.unboundedPreceding, 0)
    heads = listed.where("a = rep and (token & 63) > 0").withColumn("head", F.first(F.struct("rep", "x")).over(by_token))
    across = heads.where("head.rep <> rep").select(F.col("head.rep").alias("a"), F.col("rep").alias("b"), F.col("head.x").alias("x"), F.col("x").alias("y"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))
    return stored(_candidates(in_part.union(across)).withColumn("best", best).where(F.col("best") <= FIRST).select("a", "b"))


def _open(listed: DataFrame, known: DataFrame) -> DataFrame:
    """(token, rep, x, component, lead, members) of lists with members in different components, stored; lead is the first member's."""
    member = listed.select("token", "rep", "x").join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = F.min(F.struct(F.xxhash64("rep"), "rep", "component"))["component"]
    lists = member.groupBy("token").agg(first.alias("lead"), F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members"))
    return stored(member.join(lists.where("least <> most").select("token", "lead", "members"), "token"))


def _chunked(opened: DataFrame) -> DataFrame:
    """(lead, c_strays, c_members), stored: leads whose lists would make more pairs than sending texts is worth, and their numbers of chunks."""
    stray = F.col("component") != F.col("lead")
    pairs = opened.groupBy("lead").agg(F.sum(F.when(stray, F.col("members")).otherwise(0)).alias("pairs"))
    weight = _size("x") + CHUNK_TEXT
    texts = opened.select("lead", "rep", weight.alias("weight"), stray.alias("stray")).distinct()
    sizes = texts.groupBy("lead").agg(F.sum(F.when(F.col("stray"), F.col("weight")).otherwise(0)).alias("strays"), F.sum("weight").alias("all"))
    return stored(pairs.join(sizes, "lead").where(F.col("pairs") * PAIR > F.col("all")).select("lead", F.ceil(F.col("strays") / CHUNK).alias("c_strays"), F.ceil(F.col("all") / CHUNK).alias("c_members")))


def _met(opened: DataFrame, chunked: DataFrame, docs: DataFrame, shared) -> DataFrame:
    """(a, b), stored: links between strays and members of other components, in the lists of ``chunked`` leads; enough to join what links."""
    texts = opened.join(chunked, "lead").select("lead", F.col("rep").alias("id"), "component", "c_strays", "c_members").distinct()
    at = lambda chunks: F.pmod(F.xxhash64("id"), chunks).alias("at")
    every = lambda chunks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1))
    members = texts.select("lead", "id", "component", F.lit(False).alias("stray"), every("c_strays").alias("i"), at("c_members").alias("j"))
    strays = texts.where("component <> lead").select("lead", "id", "component", F.lit(True).alias("stray"), at("c_strays").alias("i"), every("c_members").alias("j"))
    assigned = stored(members.union(strays.select(*members.columns)))

    def meet(group: pa.Table) -> pa.Table:
        sketch, floor = shared.value
        sides: tuple[dict, dict] = {}, {}
        for id_, component, stray, text in zip(*(group.column(c).to_pylist() for c in ("id", "component", "stray", "text")), strict=True):
            if id_ not in sides[stray]:
                h = hashes(text)
                tokens, least = prefix(h, sketch, floor)
                sides[stray][id_] = component, h, tokens, least
        found = chunk_links(*(list(zip(side, *zip(*side.values(), strict=True), strict=True)) if side else [] for side in (sides[True], sides[False])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    out = stored(_with_texts(assigned, docs).groupBy("lead", "i", "j").applyInArrow(meet, "a long, b long"))
    release(assigned)
    return out


def _incidence(rows, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the prefix shingles of ``rows`` that are in the vocabulary, by column."""
    row = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    token = np.concatenate([r[3] for r in rows])
    place = np.minimum(np.searchsorted(vocabulary, token), len(vocabulary) - 1)
    hit = vocabulary[place] == token
    order = np.argsort(place[hit], kind="stable")
    return row[hit][order], place[hit][order]


def chunk_links(strays, members, block: int = 2048) -> list[tuple[int, int]]:
    """Links (stray, member) that join different components, from rows (id, component, set, prefix, l).

    The numbers of shared prefix shingles are a product of incidence matrices,
    built in blocks of columns. Each stray's candidates are verified best first;
    pairs whose components are joined by then are left out.
    """
    if not strays or not members:
        return []
    vocabulary = np.intersect1d(np.concatenate([r[3] for r in strays]), np.concatenate([r[3] for r in members]))
    if not len(vocabulary):
        return []
    (row_a, col_a), (row_b, col_b) = _incidence(strays, vocabulary), _incidence(members, vocabulary)
    shared = np.zeros((len(strays), len(members)), np.float32)
    for start in range(0, len(vocabulary), block):
        width = min(block, len(vocabulary) - start)
        parts = []
        for row, col, height in ((row_a, col_a, len(strays)), (row_b, col_b, len(members))):
            some = slice(*np.searchsorted(col, [start, start + width]))
            part = np.zeros((height, width), np.float32)
            part[row[some], col[some] - start] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    ids, comps, sets, _, least = zip(*members, strict=True)
    sizes, least = np.array([len(h) for h in sets]), np.array(least)
    parent: dict[int, int] = {}

    def root(c):
        while c in parent:
            c = parent[c]
        return c

    found = []
    for k, (id_, component, h, _, l_own) in enumerate(strays):
        fits = (shared[k] >= np.minimum(least, l_own)) & (100 * np.minimum(sizes, len(h)) >= PERCENT * np.maximum(sizes, len(h)))
        some = np.flatnonzero(fits)
        for m in some[np.argsort(-shared[k][some], kind="stable")]:
            one, other = root(component), root(comps[m])
            if one != other and _links(h, sets[m]):
                parent[max(one, other)] = min(one, other)
                found.append((id_, ids[m]))
    return found


def _crossing(opened: DataFrame, chunked: DataFrame) -> DataFrame:
    """(a, b), stored: candidates whose members are in different components, from the lists of other leads than the ``chunked`` ones.

    A pair that shares a list of a chunked lead as well is compared there, so its
    shingles need not all be counted here.
    """
    rest = opened.join(chunked, "lead", "left_anti").withColumn("stray", F.col("component") != F.col("lead"))
    one = rest.where("stray").select("token", F.col("rep").alias("a"), "x", F.col("component").alias("c"))
    two = rest.select("token", F.col("rep").alias("b"), F.col("x").alias("y"), F.col("component").alias("d"), "stray")
    cross = one.join(two, "token").where("c <> d and (not stray or a < b)")
    # a pair may meet either way round, as its members can stray in different lists
    return stored(_candidates(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "x", "y")).select("a", "b"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of ``df``.

    n_shingles is the size of the row's set, component_id the smallest id that
    links lead to, itself included. Null and empty texts have an empty set and
    link with nothing. A row without an id gets its class's component (null if
    no row of the class has an id). Repeated rows stay and link with each other;
    ids are taken to name one text. An empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stored(_sets(docs))
    rows = sets.where("sketch is null").select("id", "n", "sig")
    counts = _frequencies(sets)
    shared = docs.sparkSession.sparkContext.broadcast((counts.astype(np.float64), float(np.median(counts))))
    classes = stored(_prefixes(docs, shared))
    listed = _listed(classes)
    release(classes)

    star = _star(listed)
    links = _verified(star, docs)
    known = components(links)
    release(star, links)

    opened = _open(listed, known)
    release(listed)
    chunked = _chunked(opened)
    met = _met(opened, chunked, docs, shared)
    cross = _crossing(opened, chunked)
    shared.destroy()  # all that reads it is stored
    links = _verified(cross, docs)
    release(opened, chunked, cross)
    more = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(met).union(links)
    joined = components(more)
    release(known, met, links)

    counted = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("_n"))
    found = counted.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    # a class of one row that links with nothing needs no look-up
    found = stored(found.where("_n > 1 or component_id <> rep").select("sig", "component_id", "_n"))
    release(joined)
    result = look_up(rows, found, "sig", rows.count())
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without near-duplicates: of each component the row with the smallest id stays.

    Rows without an id, and texts without words, stay. Of rows that share an id one stays.
    """
    result = stored(join(df, id_col, text_col))
    gone = stored(result.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct())
    kept = only_ids(df, gone, id_col, "left_anti")
    twice = stored(result.where(f"component_id = {id_col}").groupBy(id_col).count().where("count > 1").select(id_col))
    if twice.isEmpty():
        return kept
    return only_ids(kept, twice, id_col, "left_anti").union(only_ids(kept, twice, id_col).dropDuplicates([id_col]))
