"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. They are
rotated by a fixed random rotation, which spreads that distance, and split into
blocks of WIDTH dimensions. A pair that links lies, in at least one block, within
that block's share of the squared distance, in proportion to its dimensions.

In each block a range join finds such pairs: the first few dimensions are laid
out in cells as wide as the block's radius, so partners lie in the same or
neighbouring cells; a vector is sent to those neighbours only whose nearest
point lies within the radius. Cells with many vectors are cut into chunks and a group
holds one chunk of either cell, so groups are bounded. Groups compare vectors in
eight bits a dimension, with the rounding error added to the radius; the union
of what they let pass is then verified in double precision.

Equal vectors form one class that is joined once and counted by its size.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordlattice.llm.common import components, look_up, stored

COSINE = 0.95
WIDTH = 8
#: Vectors of a cell that meet in one group, at least; more only so that there are few hot cells.
CHUNK = 4_096
#: Vectors that a cell should hold, about: the number of gridded dimensions follows from it.
CELL = 2_000
SCALE = 127.0


@lru_cache(4)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[tuple[int, int]]:
    return [(i, min(d, i + WIDTH)) for i in range(0, d, WIDTH)]


def radius(d: int, width: int, cosine: float) -> float:
    """Radius of a block's share of the squared distance, with room for rounding in double precision."""
    return math.sqrt(max(0.0, 2 - 2 * cosine) * width / d) * (1 + 1e-9) + 1e-9


def usable(v) -> np.ndarray | None:
    """A vector in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    if not v or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    return a if np.isfinite(a).all() and a.any() else None


def unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max()
    return a / np.linalg.norm(a)


def _scaled(a: np.ndarray) -> np.ndarray:
    """``a``, or a multiple of it by a power of two if its squares could overflow or vanish."""
    _, power = math.frexp(np.abs(a).max())
    return a if abs(power) < 200 else np.ldexp(a, -power)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = _scaled(a), _scaled(b)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def _read(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, sig, v): v in double precision, sig its digest; both null where a vector links with nothing."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data = [None if i is None or (a := usable(v)) is None else a.tobytes() for i, v in zip(ids, batch.column(1).to_pylist(), strict=True)]
            sigs = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(data, pa.binary())], names=["id", "sig", "v"])

    return df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "id long, sig binary, v binary")


def _placed(v: bytes, grid: int, limit: float):
    """Of a vector: its dimensions, its eight-bit rotation, and for each block its cell and the place in it (0 to 1 in each dimension)."""
    a = np.frombuffer(v, np.float64)
    d = len(a)
    x = rotation(d) @ unit(a)
    cells = []
    for i, j in blocks(d):
        at = x[i : min(j, i + grid)] / radius(d, j - i, limit)
        low = np.floor(at)
        cells.append((tuple(low.astype(int).tolist()), (at - low).tolist()))
    return d, np.rint(x * SCALE).astype(np.int8).tobytes(), cells


def _near(d: int, block: int, one: np.ndarray, two: np.ndarray, limit: float) -> np.ndarray:
    """Index pairs within the block's radius and the whole distance, rounding allowed for."""
    i, j = blocks(d)[block]
    step = 0.5 / SCALE
    reach = radius(d, j - i, limit) + 2 * step * math.sqrt(j - i)
    whole = math.sqrt(max(0.0, 2 - 2 * limit)) + 2 * step * math.sqrt(d) + 1e-6
    x, y = one.astype(np.float32) / SCALE, two.astype(np.float32) / SCALE
    bx, by = x[:, i:j], y[:, i:j]
    out = []
    for k in range(0, len(x), 512):  # a strip at a time
        part = bx[k : k + 512]
        square = (part * part).sum(1)[:, None] + (by * by).sum(1)[None] - 2 * (part @ by.T)
        a, b = np.nonzero(square <= reach * reach + 1e-5)
        gap = x[a + k] - y[b]
        keep = np.einsum("ij,ij->i", gap, gap) <= whole * whole + 1e-5
        out.append(np.stack((a[keep] + k, b[keep])))
    return np.concatenate(out, 1) if out else np.zeros((2, 0), int)


def _candidates(classes: DataFrame, count: int, limit: float) -> DataFrame:
    """Pairs (a, b) of class ids that the blocks let pass; each at least once."""
    grid = min(WIDTH, max(1, math.ceil(math.log(max(2, count) / CELL) / math.log(7))))
    chunk = max(CHUNK, count // 500)

    def place(batches):
        for batch in batches:
            keys = [f"{d}:{k}:{c}" for v in batch.column(1).to_pylist() for d, _, cells in [_placed(v, grid, limit)] for k, (c, _) in enumerate(cells)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["cell"])

    hot = classes.select("rep", "v").mapInArrow(place, "cell string").groupBy("cell").count().where(F.col("count") > chunk)
    # cells of more than a 500th of all vectors, so at most 500 in each block
    chunks = classes.sparkSession.sparkContext.broadcast({r["cell"]: -(-r["count"] // chunk) for r in hot.collect()})
    steps = [s for s in product((-1, 0, 1), repeat=grid) if s > (0,) * grid]

    def emit(batches):
        many = chunks.value
        for batch in batches:
            keys, sides, ids, data = [], [], [], []

            def add(name, side, rep, q):
                keys.append(name)
                sides.append(side)
                ids.append(rep)
                data.append(q)

            for rep, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d, q, cells = _placed(v, grid, limit)
                for k, (own, place) in enumerate(cells):
                    here = f"{d}:{k}:{own}"
                    n = many.get(here, 1)
                    mine = rep % n
                    for other in range(n):  # its own cell: chunks meet in either order, once
                        low, high = min(mine, other), max(mine, other)
                        add(f"{here}|{here}|{low}|{high}", int(mine > other), rep, q)
                    for step in steps:
                        step = step[: len(own)]
                        if not any(step):
                            continue
                        up, down = tuple(a + b for a, b in zip(own, step, strict=True)), tuple(a - b for a, b in zip(own, step, strict=True))
                        # squared distance to the two cells, in radii; a little over 1 is let pass for rounding
                        ahead = sum((1 - p if s > 0 else p) ** 2 for s, p in zip(step, place, strict=True) if s)
                        behind = sum((p if s > 0 else 1 - p) ** 2 for s, p in zip(step, place, strict=True) if s)
                        for other, side, far_off in ((f"{d}:{k}:{up}", 0, ahead), (f"{d}:{k}:{down}", 1, behind)):
                            if far_off > 1 + 1e-6:
                                continue
                            for far in range(many.get(other, 1)):
                                add(f"{here}|{other}|{mine}|{far}" if side == 0 else f"{other}|{here}|{far}|{mine}", side, rep, q)
                if len(keys) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((keys, pa.string()), (sides, pa.int32()), (ids, pa.int64()), (data, pa.binary()))], names=["name", "side", "rep", "q"])
                    keys, sides, ids, data = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((keys, pa.string()), (sides, pa.int32()), (ids, pa.int64()), (data, pa.binary()))], names=["name", "side", "rep", "q"])

    def compare(group: pa.Table) -> pa.Table:
        name = group.column("name")[0].as_py()
        one, two, low, high = name.split("|")
        d, block = map(int, one.split(":")[:2])
        side = group.column("side").to_numpy()
        reps = group.column("rep").to_numpy()
        q = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int8).reshape(-1, d)
        same = one == two and low == high
        x, y = (side == 0), (side == 0 if same else side == 1)
        a, b = _near(d, block, q[x], q[y], limit) if x.any() and y.any() else np.zeros((2, 0), int)
        a, b = reps[x][a], reps[y][b]
        if same:
            a, b = a[keep := a < b], b[keep]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return classes.select("rep", "v").mapInArrow(emit, "name string, side int, rep long, q binary").groupBy("name").applyInArrow(compare, "a long, b long").distinct()


def join(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of ``df``.

    Rows link whose cosine in double precision is ``limit`` or more. Vectors that
    are null, empty, zero or hold null or non-finite components, rows without an
    id, and vectors of different lengths link with nothing. Every row counts as
    a vector of its own, so repeated rows link with each other. component_id is
    the smallest id that links lead to, kept tells whether it is the row's own.
    """
    rows = stored(_read(df, id_col, vector_col))
    classes = stored(rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    pairs = stored(_candidates(classes, classes.count(), limit))
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("v").alias("v_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("v").alias("v_b"))

    def verify(batches):
        for batch in batches:
            keep = [cosine(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)) >= limit for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)], names=["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))

    links = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(verify, "a long, b long, n_a long, n_b long")
    links = stored(links)
    both = links.select(F.col("a").alias("rep"), F.col("n_b").alias("m")).union(links.select("b", "n_a"))
    degrees = both.groupBy("rep").agg(F.sum("m").alias("links"))
    found = classes.select("sig", "rep", "n").join(degrees, "rep", "left").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("sig", F.col("n").alias("_n"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    result = look_up(rows.select("id", "sig"), stored(found), "sig", rows.count())
    own = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("id")).alias("kept"))
