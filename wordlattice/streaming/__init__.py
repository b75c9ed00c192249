"""The line operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordlattice.operators import render
from wordlattice.operators.segment import Options, segment
from wordlattice.sources.lexicon import Lexicon


def read_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of text files as they appear in a folder, as column ``text``."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(F.regexp_replace("value", "\r\\z", "").alias("text"))


def segment_stream(lines: DataFrame, lexicon: Lexicon | None = None, options: Options = Options(), out: str = "space") -> DataFrame:
    """Lines with a rendered segmentation: 'space', 'zwsp', 'clusters' or 'tokens'.

    Stateless: each line is done by itself, so no watermark is needed and any
    output mode but 'complete' fits.
    """
    rows = segment(lines, lexicon, options)
    if out == "tokens":
        return rows
    shown = {"space": render.to_space, "zwsp": render.to_zwsp, "clusters": render.to_clusters}[out]
    return rows.select("text", shown(F.col("tokens")).alias("segmented"))
