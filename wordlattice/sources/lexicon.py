"""Lexicons: reading, checking, costs, statistics, Parquet storage.

A lexicon is a DataFrame (entry, word, count, cost, n_clusters, n_chars) and a
one-row Meta on the driver. Words are unique and, unless asked otherwise, in
canonical order; entries are numbered by first appearance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordlattice.functions import columns as fn

ALPHA = 0.5
MOST_PROBLEMS = 1000


@dataclass(frozen=True)
class Meta:
    """Scalars of a lexicon."""

    format: str = "count"
    total: float = 0.0
    max_cost: float = 0.0
    max_chars: int = 0
    max_clusters: int = 0
    unknown_override: float | None = None

    @property
    def unknown_cost(self) -> float:
        return self.max_cost + 1 if self.unknown_override is None else self.unknown_override


@dataclass
class Lexicon:
    """Entries, scalars, and the problems met while reading (None if built from clean words)."""

    entries: DataFrame
    meta: Meta
    problems: DataFrame | None = None
    report: dict[str, int] | None = None


def parse(lines: DataFrame) -> DataFrame:
    """One row for each line that holds a word or a directive, from (line, value) with binary or text values.

    Columns: line, kind ('word', 'directive'), word, value, problem (null if the
    line is fine), warning, rejected, format and unknown cost as set so far.
    """
    raw = F.col("value").cast("binary").cast("string")
    text = F.when(F.col("line") == 1, F.regexp_replace(raw, "^\\x{FEFF}", "")).otherwise(raw)
    valid = F.is_valid_utf8(raw)
    text = fn.trim(F.when(valid, text).otherwise(F.make_valid_utf8(text)))
    rows = lines.select(F.col("line").cast("long").alias("line"), text.alias("text"), valid.alias("valid")).where("text <> ''")
    body = fn.trim(F.substring("text", 2, 1 << 30))
    setting = fn.trim(F.regexp_replace(body, "^(format|unknown-cost):", ""))
    parts = F.split("text", "\t")
    rows = rows.withColumn("comment", F.col("text").startswith("#"))
    rows = rows.withColumn("key", F.when(F.col("comment"), F.regexp_extract(body, "^(format|unknown-cost):", 1))).withColumn("setting", F.when(F.col("comment"), setting))
    rows = rows.where("not comment or key <> ''")
    number = fn.parse_double(F.col("setting"))
    rows = rows.select(
        "line", "comment", "key", "setting", "valid",
        F.when(~F.col("comment"), fn.trim(parts[0])).alias("word"),
        F.when(~F.col("comment"), F.nullif(fn.trim(F.get(parts, F.lit(1))), F.lit(""))).alias("raw_value"),
        F.when((F.col("key") == "format") & F.col("setting").isin("count", "logprob"), F.col("setting")).alias("set_format"),
        F.when((F.col("key") == "unknown-cost") & (number > 0), number).alias("set_unknown"),
    )
    # directives hold from their line on; a lexicon file is read in order by one task
    so_far = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("format", F.coalesce(F.last("set_format", ignorenulls=True).over(so_far), F.lit("count")))
    rows = rows.withColumn("unknown", F.last("set_unknown", ignorenulls=True).over(so_far))
    value = fn.parse_double(F.col("raw_value"))
    rejected = (
        F.when(F.col("raw_value").isNotNull() & value.isNull(), F.concat(F.lit("bad number '"), F.col("raw_value"), F.lit("'")))
        .when(~F.col("valid"), "invalid UTF-8")
        .otherwise(F.coalesce(fn.reject_reason(F.col("word")), F.when((F.col("format") == "count") & (value < 0), "negative count").when((F.col("format") == "logprob") & (value > 0), "log probability above 0")))
    )
    rows = rows.withColumn("number", value).withColumn("rejected", F.when(~F.col("comment"), rejected))
    issue = F.get(fn.cluster_issues(F.col("word")), F.lit(0))
    warning = F.when(~F.col("comment") & F.col("rejected").isNull() & issue.isNotNull(), F.concat(F.lit("kept, but cluster check found "), issue["kind"], F.lit(" at offset "), issue["offset"].cast("string")))
    bad = F.when((F.col("key") == "format") & F.col("set_format").isNull(), F.concat(F.lit("unknown format '"), F.col("setting"), F.lit("', using count"))).when((F.col("key") == "unknown-cost") & F.col("set_unknown").isNull(), "bad unknown-cost value")
    rows = rows.withColumn("warning", warning).withColumn("problem", F.coalesce("rejected", warning, bad))
    return rows.select("line", F.when(F.col("comment"), "directive").otherwise("word").alias("kind"), F.coalesce("word", F.lit("")).alias("word"), F.col("number").alias("value"), "problem", "warning", "rejected", "format", "unknown")


def accepted(parsed: DataFrame) -> DataFrame:
    """(line, word, value) of the lines that give an entry."""
    return parsed.where("kind = 'word' and rejected is null").select("line", "word", "value")


def combine(words: DataFrame, format: str = "count", normalize: bool = True) -> DataFrame:
    """(line, word, value, rows) of distinct words from (line, word, value): counts add up, of log probabilities the best stays.

    Words without a value keep none. With ``normalize`` two spellings of a word are one.
    """
    word = fn.normalize(F.col("word")) if normalize else F.col("word")
    value = F.sum("value") if format == "count" else F.max("value")
    return words.select("line", word.alias("word"), "value").groupBy("word").agg(F.min("line").alias("line"), value.alias("value"), F.count("*").alias("rows"))


def with_costs(words: DataFrame, format: str = "count", alpha: float = ALPHA) -> DataFrame:
    """Adds count and cost to distinct words: a smoothed unigram model, or negated log probabilities."""
    if not alpha > 0:
        raise ValueError("alpha must be > 0")
    if format == "count":
        totals = words.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("*").alias("size"))
        count = F.coalesce("value", F.lit(0.0))
        cost = -F.log((count + alpha) / (F.col("total") + alpha * F.col("size")))
    else:
        totals = words.agg(F.greatest(F.coalesce(F.max(-F.col("value")), F.lit(0.0)), F.lit(0.0)).alias("worst"))
        count = F.lit(0.0)
        cost = F.coalesce(-F.col("value"), F.col("worst"))
    # the totals are one row
    joined = words.crossJoin(F.broadcast(totals))
    return joined.withColumn("count", count).withColumn("cost", cost).drop(*totals.columns)


def numbered(words: DataFrame) -> DataFrame:
    """Lexicon columns for distinct words with costs; entries are numbered by first line, then word."""
    entry = F.row_number().over(Window.orderBy("line", "word")) - 1
    return words.select(entry.cast("long").alias("entry"), "word", "count", "cost", F.size(fn.clusters(F.col("word"))).alias("n_clusters"), F.char_length("word").alias("n_chars"))


def build(words: DataFrame, format: str = "count", alpha: float = ALPHA, unknown_cost: float | None = None, normalize: bool = True, keep: bool = False) -> Lexicon:
    """A lexicon of (line, word, value) rows that need no more checks; with ``keep`` its entries are persisted before they are first read."""
    entries = numbered(with_costs(combine(words, format, normalize), format, alpha))
    entries = entries.persist() if keep else entries
    return Lexicon(entries, meta_of(entries, format, unknown_cost))


def meta_of(entries: DataFrame, format: str = "count", unknown_cost: float | None = None) -> Meta:
    row = entries.agg(F.sum("count"), F.max("cost"), F.max("n_chars"), F.max("n_clusters")).first()
    return Meta(format, float(row[0] or 0) if format == "count" else 0.0, float(row[1] or 0), int(row[2] or 0), int(row[3] or 0), unknown_cost)


def read_tsv(spark: SparkSession, path: str, **options) -> Lexicon:
    """Reads a lexicon file: a word a line, maybe a tab and a number; see parse()."""
    content = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "value"))
    size = content.agg(F.max("line")).first()[0]
    lines = content.where((F.col("line") < size) | (F.col("value") != "")).select((F.col("line") + 1).alias("line"), "value")
    return from_lines(lines, **options)


def from_lines(lines: DataFrame, alpha: float = ALPHA, unknown_cost: float | None = None, normalize: bool = True) -> Lexicon:
    """A lexicon, its problems and its load report from (line, value) rows."""
    parsed = parse(lines).cache()
    last = parsed.orderBy(F.desc("line")).select("format", "unknown").first()
    format, override = (last[0], last[1]) if last else ("count", None)
    lexicon = build(accepted(parsed), format, alpha, unknown_cost if unknown_cost is not None else override, normalize)
    lexicon.problems = problems(parsed)
    counts = parsed.agg(F.count("rejected"), F.count("warning"), F.count_if((F.col("kind") == "word") & F.col("rejected").isNull())).first()
    size = lexicon.entries.count()
    lexicon.report = {"lines": lines.count(), "entries": size, "rejected": counts[0], "warnings": counts[1], "duplicates": counts[2] - size}
    return lexicon


def problems(parsed: DataFrame) -> DataFrame:
    """(line, word, message) of the first problems."""
    return parsed.where("problem is not null").select("line", "word", F.col("problem").alias("message")).orderBy("line").limit(MOST_PROBLEMS)


def from_words(spark: SparkSession, words: list[tuple[str, float | None]], **options) -> Lexicon:
    """A lexicon of a small list of words with counts (or log probabilities)."""
    rows = [(i, w, None if v is None else float(v)) for i, (w, v) in enumerate(words)]
    return build(spark.createDataFrame(rows, "line long, word string, value double"), **options)


def stats(entries: DataFrame) -> DataFrame:
    """(statistic, bucket, n): words, counted words, one-cluster words, and histograms of clusters (to 8) and cost / 4 (to 7)."""
    clusters, cost = F.least("n_clusters", F.lit(8)), F.least(F.floor(F.col("cost") / 4), F.lit(7))
    def row(name: str, bucket, hit):
        return F.struct(F.lit(name).alias("statistic"), bucket.cast("long").alias("bucket"), hit.cast("int").alias("hit"))

    zero, one = F.lit(0), F.lit(1)
    rows = F.array(row("words", zero, one), row("counted", zero, F.col("count") > 0), row("one_cluster", zero, F.col("n_clusters") == 1), row("clusters", clusters, one), row("cost", cost, one))
    return entries.select(F.explode(rows).alias("x")).groupBy(F.col("x.statistic").alias("statistic"), F.col("x.bucket").alias("bucket")).agg(F.sum("x.hit").alias("n"))


def longest(entries: DataFrame, n: int = 5) -> DataFrame:
    """The longest words."""
    return entries.orderBy(F.desc("n_chars"), "entry").limit(n).select("word", "n_chars")


def save(lexicon: Lexicon, path: str) -> None:
    """Parquet folders ``entries`` and ``meta`` below ``path``."""
    spark = lexicon.entries.sparkSession
    m = lexicon.meta
    lexicon.entries.write.mode("overwrite").parquet(f"{path}/entries")
    row = [(m.format, m.total, m.max_cost, m.max_chars, m.max_clusters, m.unknown_override)]
    spark.createDataFrame(row, "format string, total double, max_cost double, max_chars int, max_clusters int, unknown_override double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Lexicon:
    """What save() wrote."""
    return Lexicon(spark.read.parquet(f"{path}/entries"), Meta(*spark.read.parquet(f"{path}/meta").first()))


def open_lexicon(spark: SparkSession, path: str | None = None, **options) -> Lexicon:
    """A saved lexicon or a lexicon file; without a path the one in ``spark.wordlattice.lexicon``."""
    path = path or spark.conf.get("spark.wordlattice.lexicon", None)
    if not path:
        raise ValueError("no lexicon: name a path or set spark.wordlattice.lexicon")
    try:
        return load(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return read_tsv(spark, path, **options)
