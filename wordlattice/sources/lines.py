"""Line sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordlattice.functions import columns as fn

BOM = "﻿"


#: Rows of the table of splits that is broadcast, at most (one row for each split of a file).
BROADCAST_SPLITS = 200_000


def read_lines(spark: SparkSession, paths: str | Sequence[str], strict: bool = False) -> DataFrame:
    """(file, line, number, text, ending, had_bom) of uncompressed text files of any size.

    Lines end at a line feed; a carriage return before it belongs to the ending,
    and one at the end of an unterminated last line is dropped. ``line`` counts
    within a file, ``number`` over all files in the order of ``paths``. A byte
    order mark is dropped from a file's first line. Ill-formed bytes become
    U+FFFD, or an error if ``strict``. Empty files, and files of a mark only, have
    no lines.

    Files are split as Spark's text source does it, and lines aren't shuffled: a
    first pass counts each split's lines and bytes, and the second adds what
    stands before its split. What a file's size has beyond its lines' bytes tells
    whether it has a mark and whether its last line is terminated.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    inputs = [spark.read.option("lineSep", "\n").text(p) for p in paths]
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes")
    parts = [df.select(F.lit(i).alias("input"), *place, F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("value")) for i, df in enumerate(inputs)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    split = ["input", "file", "block"]
    counts = rows.groupBy(*split).agg(F.min("seq").alias("first"), F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("used"), F.max("bytes").alias("bytes"))
    # one row for each split of a file meets in one task
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("input", "file")
    over = F.col("bytes") - F.sum("used").over(inside)  # 3 for a mark, less 1 for a last line without its end
    places = counts.select(
        *split, "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("lines").over(inside.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"),
        F.sum("lines").over(inside).alias("count"), over.isin(0, 3).alias("ended"), (over >= 2).alias("marked"),
    )
    places = F.broadcast(places) if sum(map(_most_splits, inputs)) <= BROADCAST_SPLITS else places
    value = F.col("value")
    text = fn.strict(value) if strict else fn.repair(value)
    line = F.col("above") + F.col("seq") - F.col("first") + 1
    lines = rows.drop("bytes").join(places, split).select("file", line.alias("line"), (F.col("base") + F.col("seq") - F.col("first") + 1).alias("number"), text.alias("value"), "count", "ended", "marked")
    terminated = F.col("ended") | (F.col("line") < F.col("count"))
    return lines.select(
        "file", "line", "number", F.regexp_replace("value", "\r\\z", "").alias("text"),
        F.when(~terminated, "").when(F.col("value").endswith("\r"), "\r\n").otherwise("\n").alias("ending"),
        (F.col("marked") & (F.col("line") == 1)).alias("had_bom"),
    )


def _most_splits(df: DataFrame) -> int:
    """How many splits a text scan has, at most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Spark splits no finer than the cost of opening a file
    least = int(df.sparkSession._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    return size // max(least, 1) + len(df.inputFiles())


def write_lines(df: DataFrame, path: str, text_col: str = "text", order_col: str | None = "number", ending_col: str | None = None, bom_col: str | None = None) -> None:
    """Writes a text column, ordered over all files if ``order_col`` is named.

    Lines end with a line feed. With ``ending_col`` those that had a carriage
    return before it get it back, and with ``bom_col`` marked lines their byte
    order mark; only the end of an unterminated last line can't be left out.
    """
    out = df.orderBy(order_col) if order_col else df
    value = F.col(text_col)
    if bom_col:
        value = F.concat(F.when(F.col(bom_col), BOM).otherwise(""), value)
    if ending_col:
        value = F.concat(value, F.when(F.col(ending_col) == "\r\n", "\r").otherwise(""))
    out.select(value.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
