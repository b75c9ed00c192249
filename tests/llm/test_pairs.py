"""The Jaccard join and the embedding join against brute force, on made-up hard cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordlattice.llm import common, embdedup, jaccard


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(a, b):
    common = len(a & b)
    return bool(a) and bool(b) and 100 * common >= 75 * (len(a) + len(b) - common)


def corpus():
    """Groups of near copies around the threshold, shared passages, copies, short texts, odd rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.sample(words, 60)
    texts = []
    for _ in range(12):
        base = rng.sample(words, rng.choice([30, 60, 120]))
        for _ in range(rng.choice([2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    for k in range(40):  # mostly one passage, with a few words around it
        texts.append(" ".join(rng.sample(words, k // 4) + passage + rng.sample(words, k // 5)))
    texts += [" ".join(rng.sample(words, 80)) for _ in range(20)]
    texts += texts[:5] + [texts[0].upper(), "", " \t\n", None, None, "one two", "One  two", "one two three", "a b c d e", "a b c d e f", "ab " * 50, "ab " * 60, "x" * 5000, "é è ê ë ē"]
    return [(i, t) for i, t in enumerate(texts)]


def brute(rows):
    sets = {i: jaccard.shingles(t) for i, t in rows}
    ids = sorted(sets)
    return sets, groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if similar(sets[a], sets[b])])


def test_jaccard_join(spark):
    rows = corpus()
    sets, want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn("a", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}
    assert len(set(want.values())) < len(rows) - 50


def near_threshold(size=60):
    """One group of near copies, many of them just below the threshold with each other, and a passage that all share."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(3000)]
    base = rng.sample(words, 150)
    rows = []
    for i in range(size):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("pair", "part", "chunk"), [(10**6, 1000, 400_000), (10**6, 4, 3_000), (0, 4, 400_000)])
def test_jaccard_large_group_below_threshold(spark, monkeypatch, pair, part, chunk):
    """Chunks (pairs are dear), several chunks and split lists, and the join by shingle (pairs are free) agree with brute force."""
    monkeypatch.setattr(jaccard, "PAIR", pair)
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_threshold()
    sets, want = brute(rows)
    below = sum(1 for a in sets for b in sets if a < b and 60 <= 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 75)
    assert below > 200
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("block", [7, 2048])
def test_chunk_links(block):
    rows = near_threshold(40)
    sketch = np.ones(1 << jaccard.SKETCH_BITS)
    entries = []
    for i, text in rows:
        h = jaccard.hashes(text)
        entries.append((i, i, h, *jaccard.prefix(h, sketch, 0.0)))
    _, want = brute(rows)
    got = groups([i for i, _ in rows], jaccard.chunk_links(entries, entries, block))
    assert got == want
    assert jaccard.chunk_links([], entries) == jaccard.chunk_links(entries, []) == []


def test_jaccard_keeps_one(spark):
    rows = corpus()
    _, want = brute(rows)
    df = spark.createDataFrame([*rows, rows[0], (None, "no id here at all")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, c in want.items() if i == c})
    assert kept.where("doc_id is null").count() == 1


def test_jaccard_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "A b c"), (None, "x y"), (7, "A b c"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=repr)
    assert got == sorted([(7, 1, 7), (7, 1, 7), (8, 0, 8), (None, 1, 7), (None, 1, None)], key=repr)
    assert jaccard.join(df.limit(0)).collect() == []


def test_driver_gets_one_packed_sketch(spark, monkeypatch):
    texts = [" ".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(30)
    sets = jaccard.stored(jaccard._sets(docs))
    sent, collect = [], type(sets.rdd).collect
    for kind in {type(sets.rdd), *type(sets.rdd).__mro__}:
        if "collect" in vars(kind):
            monkeypatch.setattr(kind, "collect", lambda self: sent.extend(out := collect(self)) or out)
    counts = jaccard._frequencies(sets)
    assert len(sent) == 1 and len(sent[0]) < counts.nbytes // 8
    found = np.concatenate([jaccard.hashes(t) for t in texts]) >> np.uint64(64 - jaccard.SKETCH_BITS)
    assert np.array_equal(counts, np.bincount(found.astype(np.int64), minlength=1 << jaccard.SKETCH_BITS))
    assert not jaccard._frequencies(sets.where("false")).any()


def test_prefix_lengths():
    tokens = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 100, dtype=np.uint64))
    sketch = np.ones(1 << jaccard.SKETCH_BITS)
    chosen, least = jaccard.prefix(tokens, sketch, 0.0)
    assert least == 1 and len(chosen) == 100 - 75 + 1
    busy = sketch * 500
    chosen, least = jaccard.prefix(tokens, busy, 0.0)
    assert least > 1 and len(chosen) == 100 - 75 + least


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    want = groups({x for ab in links for x in ab}, links)
    assert got == {n: want[n] for n in nodes}


def vectors():
    rng = np.random.default_rng(5)
    out = [rng.normal(size=16) for _ in range(150)]
    for _ in range(15):
        base = rng.normal(size=16)
        out += [base + rng.normal(size=16) * s for s in (0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)]
    out += [out[0] * 3, out[1] * -1, out[2], out[2]]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("chunk", [4096, 20])
def test_embedding_join(spark, monkeypatch, chunk):
    monkeypatch.setattr(embdedup, "CHUNK", chunk)
    monkeypatch.setattr(embdedup, "CELL", 10)
    good = vectors()
    bad = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0001]]
    rows = list(enumerate(good + bad))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.join(df).collect()}
    a = np.array(good)
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    links = [(i, j) for i in range(len(a)) for j in range(i) if near[i, j]]
    n = len(good)
    links.append((n + 7, n + 6))  # the two short vectors
    want = groups(range(len(rows)), links)
    degree = dict.fromkeys(range(len(rows)), 0)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    assert got == {i: (degree[i], want[i], want[i] == i) for i in range(len(rows))}
    assert sum(degree.values()) > 100


def test_embedding_join_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embdedup.join(df).collect()), key=repr)
    assert got == sorted([(None, 0, None), (None, 0, None), (3, 1, 3), (3, 1, 3)], key=repr)
    assert embdedup.join(df.limit(0)).collect() == []


def test_rotation_keeps_distances():
    q = embdedup.rotation(24)
    assert np.allclose(q @ q.T, np.eye(24))


def test_look_up_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    df = spark.createDataFrame([("hot",)] * 50 + [(None,)] * 3 + [(f"k{i}",) for i in range(20)], "k string")
    found = spark.createDataFrame([("hot", 1, 50), ("k3", 2, 1)], "k string, v int, _n long")
    got = sorted(((r.k, r.v) for r in common.look_up(df, found, "k", 73).collect()), key=repr)
    assert got == sorted([("hot", 1)] * 50 + [(None, None)] * 3 + [(f"k{i}", 2 if i == 3 else None) for i in range(20)], key=repr)


@pytest.mark.parametrize("power", [-1000, -300, 0, 300, 1000])
def test_cosine_of_extreme_vectors(power):
    a, b = np.array([3.0, 4.0]), np.array([4.0, 3.0])
    assert embdedup.cosine(np.ldexp(a, power), b) == pytest.approx(0.96) == embdedup.cosine(b, np.ldexp(a, power))


def test_neighbour_cells_are_exact():
    """Each pair within the radius meets in some block: either in one cell or each within reach of the other's."""
    rng = np.random.default_rng(3)
    d, grid, limit = 24, 3, 0.9
    for _ in range(300):
        a = rng.standard_normal(d)
        b = a + rng.standard_normal(d) * rng.uniform(0, 0.15)
        if embdedup.cosine(a, b) < limit:
            continue
        (_, _, x), (_, _, y) = (embdedup._placed(v.tobytes(), grid, limit) for v in (a, b))
        meets = False
        for (one, p), (two, q) in zip(x, y, strict=True):
            step = np.subtract(two, one)
            if np.abs(step).max() <= 1:
                gaps = [sum((1 - f if s > 0 else f) ** 2 for s, f in zip(t, place, strict=True) if s) for t, place in ((step, p), (-step, q))]
                meets |= max(gaps) <= 1 + 1e-6
        assert meets
