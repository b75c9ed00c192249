"""Renderings of a token array as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordlattice.functions import charsets as cs
from wordlattice.functions import columns as fn


def _khmer(t: Column) -> Column:
    return t["type"].isin(*cs.KHMER_TYPES)


def to_space(tokens: Column, sep: str = " ") -> Column:
    """Tokens but spaces, joined by a separator (an empty one counts as a space)."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: t["type"] != "space"), lambda t: t["text"]), sep or " ")


def to_zwsp(tokens: Column) -> Column:
    """The text with a zero-width space between adjacent Khmer tokens."""

    def one(t: Column, i: Column) -> Column:
        previous = F.get(tokens, i - 1)
        return F.when((i > 0) & _khmer(t) & _khmer(previous), F.concat(F.lit(cs.ZWSP), t["text"])).otherwise(t["text"])

    return F.array_join(F.transform(tokens, one), "")


def to_clusters(tokens: Column) -> Column:
    """Tokens but spaces, joined by a space, Khmer ones with a middle dot between clusters."""

    def one(t: Column) -> Column:
        return F.when(_khmer(t), F.array_join(fn.clusters(t["text"]), cs.MIDDLE_DOT)).otherwise(t["text"])

    return F.array_join(F.transform(F.filter(tokens, lambda t: t["type"] != "space"), one), " ")


def to_jsonl(line: Column, tokens: Column, offsets: str = "codepoints") -> Column:
    """One JSON object a line: its number and all tokens with their offsets in code points or bytes."""
    if offsets not in ("codepoints", "bytes"):
        raise ValueError(f"unknown offsets {offsets!r}")
    start, end = ("byte_start", "byte_end") if offsets == "bytes" else ("start", "end")
    shown = F.transform(tokens, lambda t: F.struct(t["text"].alias("text"), t[start].alias("start"), t[end].alias("end"), t["type"].alias("type")))
    out = F.to_json(F.struct(line.alias("line"), shown.alias("tokens")))
    return F.replace(F.replace(out, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))
