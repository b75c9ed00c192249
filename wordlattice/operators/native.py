"""Segmentation with relational operators only: lattice joins and folds over arrays.

Runs are cut into clusters, spans of clusters are joined with the lexicon by
their text, and the edges of each run are folded into a path. The lexicon side
is not broadcast by this module: the planner does so where it is small, and
shuffles both sides where it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordlattice.functions import columns as fn
from wordlattice.operators.decode import EPSILON


def runs(lines: DataFrame, text_col: str = "text", normalize: bool = True) -> DataFrame:
    """Distinct Khmer runs of a text column: (run, parts), the latter as looked up."""
    tokens = lines.select(F.explode(fn.pretokenize(F.col(text_col))).alias("t")).where("t.type = 'khmer'").select(F.col("t.text").alias("run")).distinct()
    return tokens.withColumn("parts", fn.normalized_clusters(F.col("run")) if normalize else fn.clusters(F.col("run")))


def spans(parts: DataFrame, most: int, *keys: str) -> DataFrame:
    """(keys, from, to, word): all spans of at most ``most`` clusters of the array ``parts``."""
    n = F.size("parts")

    def ends(f: Column) -> Column:
        return F.transform(F.sequence(f + 1, F.least(n, f + most)), lambda t: F.struct(f.alias("from"), t.alias("to"), F.array_join(F.slice("parts", f + 1, t - f), "").alias("word")))

    # the texts are made within the row, so that exploded rows don't drag its clusters along
    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), ends))
    return parts.where(n > 0).select(*keys, F.explode(every).alias("s")).select(*keys, "s.from", "s.to", "s.word")


def lattice(parts: DataFrame, entries: DataFrame, most: int, *keys: str, unknown_cost: float | None = None) -> DataFrame:
    """(keys, from, to, cost, entry): an edge for each span that is a word and, with a cost, for each cluster as an unknown one."""
    found = spans(parts, most, *keys).join(entries.select("word", "entry", "cost"), "word").select(*keys, "from", "to", "cost", "entry")
    if unknown_cost is None:
        return found
    single = parts.select(*keys, F.posexplode("parts").alias("from", "part"))
    return found.unionByName(single.select(*keys, "from", (F.col("from") + 1).alias("to"), F.lit(float(unknown_cost)).alias("cost"), F.lit(None).cast("long").alias("entry")))


def _edge(e: Column, c: Column, n: Column) -> Column:
    return F.struct(c.alias("c"), n.alias("n"), e["from"].alias("src"), e["entry"].alias("entry"))


def viterbi_path(arriving: Column) -> Column:
    """Path (from, to, entry) from an array that has, for each boundary but the first, its sorted incoming edges.

    The cost of a boundary is final before any edge leaves it, so boundaries can
    be filled in order, each by a fold over its incoming edges in the order in
    which a left-to-right search would meet them.
    """
    state = "struct<c:double,n:int,src:int,entry:bigint>"
    origin = F.array(F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n"), F.lit(-1).alias("src"), F.lit(None).cast("long").alias("entry")))

    def boundary(done: Column, edges: Column) -> Column:
        def relax(best: Column, e: Column) -> Column:
            before = F.element_at(done, e["from"] + 1)
            c, n = before["c"] + e["cost"], before["n"] + 1
            wins = best["src"].isNull() | (c < best["c"] - EPSILON) | ((c <= best["c"] + EPSILON) & (n < best["n"]))
            return F.when(wins, _edge(e, c, n)).otherwise(best)

        return F.array_append(done, F.aggregate(edges, F.lit(None).cast(state), relax))

    table = F.aggregate(arriving, origin, boundary)
    return _trace(table)


def _trace(table: Column) -> Column:
    """The path that a table of last edges, one for each boundary, holds."""
    piece = "array<struct<from:int,to:int,entry:bigint>>"
    start = F.struct((F.size(table) - 1).alias("at"), F.array().cast(piece).alias("path"))

    def back(s: Column, k: Column) -> Column:
        last = F.element_at(table, k + 1)
        step = F.struct(last["src"].alias("from"), k.alias("to"), last["entry"].alias("entry"))
        return F.when(s["at"] == k, F.struct(last["src"].alias("at"), F.concat(F.array(step), s["path"]).alias("path"))).otherwise(s)

    downward = F.when(F.size(table) > 1, F.sequence(F.size(table) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(downward, start, back, lambda s: s["path"])


def viterbi(parts: DataFrame, entries: DataFrame, most: int, unknown_cost: float, key: str = "run") -> DataFrame:
    """(key, path): the cheapest path of each run."""
    edges = lattice(parts, entries, most, key, unknown_cost=unknown_cost)
    order = F.struct("from", F.col("entry").isNull().alias("unknown"), "cost", "entry")
    arriving = edges.groupBy(key, "to").agg(F.array_sort(F.collect_list(order)).alias("edges"))  # at most `most` + 1 edges
    table = arriving.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("to", "edges"))).alias("all"))  # one run's boundaries
    return table.select(key, viterbi_path(F.transform("all", lambda x: x["edges"])).alias("path"))


def greedy(parts: DataFrame, entries: DataFrame, most: int, key: str = "run", backward: bool = False) -> DataFrame:
    """(key, path): forward or backward maximal matching."""
    found = lattice(parts, entries, most, key)
    if backward:
        best = found.groupBy(key, "to").agg(F.min("from").alias("from"), F.min_by("entry", "from").alias("entry"))
    else:
        best = found.groupBy(key, "from").agg(F.max("to").alias("to"), F.max_by("entry", "to").alias("entry"))
    hit = F.struct(F.col("to" if backward else "from").alias("key"), F.struct("from", "to", "entry").alias("value"))
    hits = best.groupBy(key).agg(F.map_from_entries(F.collect_list(hit)).alias("hits"))
    joined = parts.join(hits, key, "left")
    n = F.size("parts")
    piece = "array<struct<from:int,to:int,entry:bigint>>"
    start = F.struct((n if backward else F.lit(0)).alias("at"), F.array().cast(piece).alias("path"))
    known = F.coalesce("hits", F.create_map().cast("map<int,struct<from:int,to:int,entry:bigint>>"))

    def walk(s: Column, k: Column) -> Column:
        hit = F.try_element_at(known, k)
        single = F.struct((k - 1 if backward else k).alias("from"), (k if backward else k + 1).alias("to"), F.lit(None).cast("long").alias("entry"))
        step = F.when(hit.isNull(), single).otherwise(F.struct(hit["from"].alias("from"), hit["to"].alias("to"), hit["entry"].alias("entry")))
        path = F.concat(F.array(step), s["path"]) if backward else F.array_append(s["path"], step)
        return F.when(s["at"] == k, F.struct((step["from"] if backward else step["to"]).alias("at"), path.alias("path"))).otherwise(s)

    places = F.sequence(n, F.lit(1), F.lit(-1)) if backward else F.sequence(F.lit(0), n - 1)
    return joined.where(n > 0).select(key, F.aggregate(places, start, walk, lambda s: s["path"]).alias("path"))


def bidirectional(parts: DataFrame, entries: DataFrame, most: int, key: str = "run") -> DataFrame:
    """(key, path): forward matching only where it is strictly better than backward."""

    def score(path: Column) -> Column:
        return F.struct(F.size(path), F.size(F.filter(path, lambda p: p["entry"].isNull())), F.size(F.filter(path, lambda p: p["entry"].isNotNull() & (p["to"] - p["from"] == 1))))

    one = greedy(parts, entries, most, key).withColumnRenamed("path", "one")
    two = greedy(parts, entries, most, key, backward=True).withColumnRenamed("path", "two")
    return one.join(two, key).select(key, F.when(score(F.col("one")) < score(F.col("two")), F.col("one")).otherwise(F.col("two")).alias("path"))


def segment_runs(parts: DataFrame, entries: DataFrame, most: int, unknown_cost: float, algorithm: str = "viterbi", key: str = "run") -> DataFrame:
    """(key, path) by any of the algorithms."""
    if algorithm == "viterbi":
        return viterbi(parts, entries, most, unknown_cost, key)
    if algorithm == "bimm":
        return bidirectional(parts, entries, most, key)
    return greedy(parts, entries, most, key, backward=algorithm == "bmm")


def merge_unknown(tokens: DataFrame, *line: str) -> DataFrame:
    """Exploded tokens (line, pos, text, start, end, type) with touching unknown ones joined: gaps and islands."""
    w = Window.partitionBy(*line).orderBy("pos")
    joins = (F.col("type") == "unknown") & (F.lag("type").over(w) == "unknown") & (F.lag("end").over(w) == F.col("start"))
    islands = tokens.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    return islands.groupBy(*line, "island").agg(text.alias("text"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("type").alias("type"))


def token_offsets(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys, pos, text, type, start, end, byte_start, byte_end): coarse tokens with running offsets."""
    rows = df.select(*keys, F.posexplode(fn.pretokenize(F.col(text_col))).alias("pos", "t")).select(*keys, "pos", "t.text", "t.type")
    so_far = Window.partitionBy(*keys).orderBy("pos")
    end, byte_end = F.sum(F.char_length("text")).over(so_far), F.sum(F.octet_length("text")).over(so_far)
    rows = rows.withColumn("end", end).withColumn("byte_end", byte_end)
    return rows.withColumn("start", F.col("end") - F.char_length("text")).withColumn("byte_start", F.col("byte_end") - F.octet_length("text"))
