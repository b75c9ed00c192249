"""Lexicon files, costs, problems, statistics, storage."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wordlattice.sources import lexicon as lx

KA, KHA, KHMER = "ញ", "ផូ", "ថ្ងៃ"


def load(spark, data, **options):
    raw = data if isinstance(data, bytes) else data.encode()
    rows = raw.split(b"\n")
    if rows[-1] == b"":
        rows.pop()
    return lx.from_lines(spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(rows, 1)], "line long, value binary"), **options)


def table(lexicon):
    return {r.word: r for r in lexicon.entries.collect()}


def messages(lexicon):
    return [(r.line, r.message) for r in lexicon.problems.collect()]


WORDS = [KA, KHA, KHMER, "រលក", "ឱ្យ", "ល៊ះ"]
#: What a field may hold: its number, or the reason to reject the line by format.
FIELDS = {"": None, "4": 4.0, "0.25": 0.25, "+1e1": 10.0, "-2": -2.0, "-.5": -0.5, "many": "bad", "1e999": "bad", "nan": "bad", "0x1": "bad"}
#: Words that can't be entries, with the reason.
ALIEN = {"ញw": "contains non-Khmer character U+0077", "ផ ូ": "contains non-Khmer character U+0020", "៌ញ": "starts with a mark", "៤៥": "contains non-Khmer character U+17E4"}


def made_file(rng, format):
    """Lines of a lexicon file, with the entries, problems and numbers that plain rules give for them."""
    lines, entries, problems, dup, rejected = [f"# format: {format}"], {}, [], 0, 0
    for _ in range(rng.randrange(0, 40)):
        roll = rng.random()
        if roll < 0.15:
            lines.append(rng.choice(["", "  \t", "# by hand", "#unknown", "\r"]))
            continue
        word = rng.choice(list(ALIEN) if roll < 0.3 else WORDS)
        field = rng.choice(list(FIELDS))
        value = FIELDS[field]
        lines.append(rng.choice(["", " "]) + word + ("" if field == "" and rng.random() < 0.5 else "\t" + field) + rng.choice(["", "\r", "\tmore"] if field else [""]))
        reason = f"bad number '{field}'" if value == "bad" else ALIEN.get(word)
        if reason is None and value is not None and (value < 0 if format == "count" else value > 0):
            reason = "negative count" if format == "count" else "log probability above 0"
        if reason:
            rejected += 1
            problems.append((len(lines), reason))
        else:
            dup += word in entries
            entries.setdefault(word, []).append(value)
    return lines, entries, problems, dup, rejected


def plain_costs(entries, format, alpha=0.5):
    if format == "count":
        counts = {w: sum(v for v in values if v is not None) for w, values in entries.items()}
        return {w: -math.log((n + alpha) / (sum(counts.values()) + alpha * len(counts))) for w, n in counts.items()}
    best = {w: max((v for v in values if v is not None), default=None) for w, values in entries.items()}
    worst = max([0.0, *(-v for v in best.values() if v is not None)])
    return {w: worst if v is None else -v for w, v in best.items()}


@pytest.mark.parametrize("format", ["count", "logprob"])
def test_files_by_plain_rules(spark, format):
    rng = random.Random(len(format))
    for k in range(6):
        lines, entries, problems, dup, rejected = made_file(rng, format)
        lex = load(spark, ("\ufeff" if k % 2 else "") + "\n".join(lines) + "\n")
        costs = plain_costs(entries, format)
        assert {w: r.cost for w, r in table(lex).items()} == pytest.approx(costs)
        assert [r.word for r in lex.entries.orderBy("entry").collect()] == list(entries)
        assert messages(lex) == problems
        assert lex.report == {"lines": len(lines), "entries": len(entries), "rejected": rejected, "warnings": 0, "duplicates": dup}
        assert lex.meta.format == format and lex.meta.unknown_cost == pytest.approx(max(costs.values(), default=0.0) + 1)
        assert format == "logprob" or lex.meta.total == pytest.approx(sum(v or 0 for values in entries.values() for v in values))


def test_bytes_that_are_no_text(spark):
    lex = load(spark, KA.encode() + b"\t2\n" + KHA.encode()[:-1] + b"\n\xff\xfe\t1\n")
    assert messages(lex) == [(2, "invalid UTF-8"), (3, "invalid UTF-8")] and list(table(lex)) == [KA]


def test_spelling_is_made_canonical_with_a_warning(spark):
    typed, kept = "ញះូ", "ញូះ"
    lex = load(spark, f"{KA}\t1\n{typed}\t2\n{kept}\t3\n")
    assert table(lex)[kept]["count"] == 5 and lex.report["warnings"] == 1 and lex.report["duplicates"] == 1
    assert messages(lex) == [(2, "kept, but cluster check found out-of-order at offset 2")]
    assert set(table(load(spark, f"{typed}\t2\n{kept}\t3\n", normalize=False))) == {typed, kept}


def test_settings_inside_a_file(spark):
    """Signs go by the format in force on a line, costs by the last format; wrong settings are reported and change nothing."""
    lex = load(spark, f"# unknown-cost: 7.25\n{KA}\t5\n#format:logprob\n{KHA}\t-1.5\n# unknown-cost: zero\n# format: tsv\n# unknown-cost: 0\n{KHMER}\n")
    assert messages(lex) == [(5, "bad unknown-cost value"), (6, "unknown format 'tsv', using count"), (7, "bad unknown-cost value")]
    assert (lex.meta.format, lex.meta.unknown_cost, lex.report["rejected"]) == ("logprob", 7.25, 0)
    assert table(lex)[KHA].cost == 1.5


def test_no_words_and_smoothing(spark):
    assert table(load(spark, "\n#\n")) == {} and load(spark, "\n").meta.unknown_cost == 1
    for alpha in (0.1, 3.0):
        costs = {w: r.cost for w, r in table(load(spark, f"{KA}\t6\n{KHA}\n", alpha=alpha)).items()}
        assert costs == pytest.approx(plain_costs({KA: [6.0], KHA: [None]}, "count", alpha))
    with pytest.raises(ValueError):
        load(spark, f"{KA}\t1\n", alpha=-1.0)


def test_files_and_storage(spark, tmp_path):
    path = tmp_path / "words.tsv"
    path.write_bytes(f"{KA}\t3\n{KHA}\t1".encode())
    lex = lx.open_lexicon(spark, str(path))
    assert sorted(table(lex)) == [KA, KHA] and lex.report["lines"] == 2
    lx.save(lex, str(tmp_path / "saved"))
    again = lx.open_lexicon(spark, str(tmp_path / "saved"))
    assert again.meta == lex.meta and again.entries.orderBy("entry").collect() == lex.entries.orderBy("entry").collect()
    spark.conf.set("spark.wordlattice.lexicon", str(tmp_path / "saved"))
    assert lx.open_lexicon(spark).meta == lex.meta
    spark.conf.unset("spark.wordlattice.lexicon")
    with pytest.raises(ValueError):
        lx.open_lexicon(spark)


def test_stats_and_longest(spark):
    lex = lx.from_words(spark, [(KA, 5), (KHA, None), ("ញរ", 1), ("រលកថ្ងៃ", 2)])
    got = {(r.statistic, r.bucket): r.n for r in lx.stats(lex.entries).collect()}
    assert got["words", 0] == 4 and got["counted", 0] == 3 and got["one_cluster", 0] == 2
    assert got["clusters", 1] == 2 and got["clusters", 2] == 1 and got["clusters", 4] == 1
    assert sum(n for (s, _), n in got.items() if s == "cost") == 4
    assert [r.word for r in lx.longest(lex.entries, 2).collect()] == ["រលកថ្ងៃ", KHA]
    assert lex.entries.where(F.col("n_clusters") > F.col("n_chars")).count() == 0
