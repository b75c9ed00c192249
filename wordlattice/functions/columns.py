"""Text functions as Spark column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordlattice.functions import charsets as cs
from wordlattice.functions import kernels

_BASE = cs.klass(*cs.BASES)
_SUB = cs.klass("cons", "indv")
_UNIT = f"(?s){cs.COENG}[{_SUB}]|."


REPLACEMENT = "\ufffd"
_NOT_RO = f"(?!{kernels.RO})[{_SUB}]"
#: A cluster that is canonical as it stands: one code point, or marks by slot without repetition.
_CANONICAL = (
    f"(?s)^(?:.|[{_BASE}][{cs.klass('robat')}]?(?:{cs.COENG}{_NOT_RO})*(?:{cs.COENG}{kernels.RO})*"
    f"[{cs.klass('shifter')}]?[{cs.klass('joiner')}]?[{cs.klass('depv')}]?[{cs.klass('sign', 'diac')}]?)\\z"
)
_KIND_POINTS = [(chr(p), str(i)) for i, k in enumerate(cs.TYPE_OF_KIND) for a, b in cs.KINDS[k] for p in range(a, b + 1)]


def unused(df, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _in(c: Column, ranges: str) -> Column:
    return c.rlike(f"^[{ranges}]")


# -- UTF-8 and small helpers ----------------------------------------------------


def repair(raw: Column) -> Column:
    """Text of bytes; each maximal ill-formed part becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def fault_offset(raw: Column) -> Column:
    """Byte offset of the first ill-formed part; null if there is none.

    Repairing keeps all before that part, so the text before the first
    replacement character that the bytes don't hold themselves gives the place.
    """
    raw = raw.cast("binary")
    parts = F.split(F.make_valid_utf8(raw.cast("string")), REPLACEMENT, -1)

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + F.octet_length(part)
        own = F.substring(raw, at + 1, F.lit(3)) == F.lit(REPLACEMENT.encode())
        return F.when(s["found"], s).otherwise(F.struct(F.when(own, at + 3).otherwise(at).alias("at"), (~own).alias("found")))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("found"))
    return F.when(~F.is_valid_utf8(raw.cast("string")), F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda s: s["at"]))


def strict(raw: Column) -> Column:
    """Text of bytes; ill-formed bytes are an error that names the first one's offset."""
    text = raw.cast("string")
    message = F.concat(F.lit("INVALID_UTF8_STRING: ill-formed at byte "), fault_offset(raw).cast("string"))
    return F.when(text.isNull() | F.is_valid_utf8(text), text).otherwise(F.raise_error(message).cast("string"))


def split_words(line: Column) -> Column:
    """Words between spaces, tabs and carriage returns."""
    return F.filter(F.split(line, "[ \t\r]+"), lambda w: w != "")


def join_words(words: Column) -> Column:
    return F.array_join(words, "")


def trim(c: Column) -> Column:
    """Without spaces and tabs at both ends, and without carriage returns at the right one."""
    return F.regexp_replace(c, "^[ \t]+|[ \t\r]+\\z", "")


def parse_double(c: Column) -> Column:
    """A number if the whole text is a plain finite decimal; else null."""
    value = c.try_cast("double")
    plain = c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(plain & ~value.isin(float("inf"), float("-inf")), value)


def hex_code(c: Column) -> Column:
    """The first code point as U+XXXX."""
    return F.format_string("U+%04X", F.ascii(c))


def is_punct_word(c: Column) -> Column:
    """Is a word made of punctuation only?"""
    return c.rlike(f"^[{cs.kind('punct')}]+\\z")


def sha1_bucket(c: Column, buckets: int) -> Column:
    """The SHA-1 of a text as a number, modulo ``buckets``."""
    size = 10 if buckets <= 1 << 22 else 5  # digits at once, so that no product is too large

    def folded(digits: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(0, 40, size):
            out = (out * (16**size) + F.conv(F.substring(digits, i + 1, size), 16, 10).cast("long")) % buckets
        return out

    return F.get(F.transform(F.array(F.sha1(c.cast("binary"))), folded), F.lit(0))  # bound to a name, so that the text is hashed once


# -- clusters ----------------------------------------------------------------------


def clusters(c: Column) -> Column:
    """The clusters of a text, in order."""
    return _all(c, cs.cluster_pattern())


def boundaries(c: Column) -> Column:
    """Code-point offsets of cluster boundaries, 0 included."""
    zero = F.array(F.lit(0))
    return F.aggregate(clusters(c), zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(x))))


def is_orphan(cluster: Column) -> Column:
    """Does a cluster begin with a mark or joiner?"""
    return _in(cluster, cs.klass(*cs.MARKS, "joiner"))


#: Items of an array that are folded with one short array of what was found.
BLOCK = 256


def _found(items: Column, state: dict[str, Column], found: str, step) -> Column:
    """What a fold over ``items`` appends to its state's ``found``, an array of that type.

    A fold copies its state at each step. So items are folded by blocks, whose
    states are short, and what blocks found is put together once a block.
    """
    empty = F.array().cast(found)

    def all_of(every: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            zero = F.struct(*(s[n].alias(n) for n in state), empty.alias("found"))
            return F.aggregate(F.slice(every, k * BLOCK + 1, BLOCK), zero, step, lambda t: F.struct(*(t[n].alias(n) for n in state), F.concat(s["all"], t["found"]).alias("all")))

        start = F.struct(*(v.alias(n) for n, v in state.items()), empty.alias("all"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(every) / BLOCK).cast("int")), start, block, lambda s: s["all"])

    return F.get(F.transform(F.array(items), all_of), F.lit(0))  # bound to a name, so that blocks don't make the items anew


def cluster_issues(c: Column) -> Column:
    """Array of (offset, kind): what is wrong with the clusters of a text."""
    issue = "array<struct<offset:int,kind:string>>"

    def one(offset: Column, kind: str, when: Column) -> Column:
        return F.when(when, F.array(F.struct(offset.cast("int").alias("offset"), F.lit(kind).alias("kind")))).otherwise(F.array().cast(issue))

    def slot(u: Column) -> Column:
        out = F.lit(6)
        for name, place in (("robat", 1), ("shifter", 3), ("joiner", 4), ("depv", 5)):
            out = F.when(_in(u, cs.klass(name)), place).otherwise(out)
        return out

    def step(s: Column, u: Column) -> Column:
        pair, dangling = F.char_length(u) == 2, u == cs.COENG
        inherent, joiner, vowel = _in(u, cs.klass("inherent")), _in(u, cs.klass("joiner")), _in(u, cs.klass("depv"))
        plain = ~pair & ~dangling & ~inherent
        again = plain & ~joiner & F.array_contains(s["seen"], u)
        counts = plain & ~again
        mine = F.when(pair, 2).otherwise(slot(u))
        found = F.concat(
            s["found"],
            one(s["place"], "dangling-coeng", dangling),
            one(s["place"], "too-many-subscripts", pair & (s["pairs"] >= 2)),
            one(s["place"], "inherent-vowel", inherent),
            one(s["place"], "duplicate-mark", again),
            one(s["place"], "multiple-vowels", counts & vowel & (s["vowels"] >= 1)),
            one(s["place"], "out-of-order", (pair | counts) & (mine < s["slot"])),
        )
        return F.struct(
            (s["place"] + F.char_length(u)).alias("place"),
            F.when(pair | counts, F.greatest(s["slot"], mine)).otherwise(s["slot"]).alias("slot"),
            (s["pairs"] + pair.cast("int")).alias("pairs"),
            (s["vowels"] + (counts & vowel).cast("int")).alias("vowels"),
            F.when(counts, F.array_append(s["seen"], u)).otherwise(s["seen"]).alias("seen"),
            found.alias("found"),
        )

    def inside(x: Column, place: Column) -> Column:
        zero = {"place": place + 1, "slot": F.lit(0), "pairs": F.lit(0), "vowels": F.lit(0), "seen": F.array().cast("array<string>")}
        return _found(_all(F.substring(x, 2, 1 << 30), _UNIT), zero, issue, step)

    def cluster(s: Column, x: Column) -> Column:
        here = F.when(is_orphan(x), one(s["place"], "orphan-mark", F.lit(True))).when(_in(x, _BASE) & (F.char_length(x) > 1), inside(x, s["place"])).otherwise(F.array().cast(issue))
        return F.struct((s["place"] + F.char_length(x)).alias("place"), F.concat(s["found"], here).alias("found"))

    return F.when(c.isNotNull(), _found(clusters(c), {"place": F.lit(0)}, issue, cluster))


# -- normalisation -------------------------------------------------------------------


def normalize_cluster(x: Column) -> Column:
    """A cluster with its marks in canonical order, inherent vowels and repeated marks dropped."""
    units = F.filter(_all(F.substring(x, 2, 1 << 30), _UNIT), lambda u: ~_in(u, cs.klass("inherent")))

    def keyed(u: Column, i: Column) -> Column:
        slot = F.when(F.char_length(u) == 2, 2)
        for name, place in (("robat", 1), ("shifter", 3), ("joiner", 4), ("depv", 5)):
            slot = slot.when(_in(u, cs.klass(name)), place)
        return F.struct(slot.otherwise(6).alias("slot"), u.endswith("រ").alias("ro"), i.alias("i"), u.alias("u"))

    start = F.struct(F.substring(x, 1, 1).alias("out"), F.lit("").alias("last"))

    def keep(s: Column, k: Column) -> Column:
        again = (F.char_length(k["u"]) == 1) & (k["u"] == s["last"])
        return F.struct(F.when(again, s["out"]).otherwise(F.concat(s["out"], k["u"])).alias("out"), F.when(again, s["last"]).otherwise(k["u"]).alias("last"))

    ordered = F.aggregate(F.array_sort(F.transform(units, keyed)), start, keep, lambda s: s["out"])
    fixed = (F.char_length(x) < 2) | ~_in(x, _BASE) | x.rlike(f"{cs.COENG}(?![{_SUB}])")
    return F.when(fixed, x).otherwise(ordered)


def normalized_clusters(c: Column) -> Column:
    return F.transform(clusters(c), lambda x: F.when(x.rlike(_CANONICAL), x).otherwise(normalize_cluster(x)))


def normalize(c: Column) -> Column:
    """normalize_cluster() over all clusters that need it; texts without two marks in a row pass by."""
    marks = cs.klass(*cs.MARKS, "joiner")
    return F.when(c.rlike(f"[{marks}][{marks}{_SUB}]|[{cs.klass('inherent')}]"), F.array_join(normalized_clusters(c), "")).otherwise(c)


# -- coarse tokens -------------------------------------------------------------------


def token_type(token: Column) -> Column:
    """Type of a coarse token by its first code point.

    One look-up: the code point is translated to its kind's number, which is a
    digit and so a code point that is translated itself.
    """
    number = F.translate(F.substring(token, 1, 1), "".join(c for c, _ in _KIND_POINTS), "".join(i for _, i in _KIND_POINTS))
    out = None
    for i, name in enumerate(cs.TYPE_OF_KIND.values()):
        out = F.when(number == str(i), name) if out is None else out.when(number == str(i), name)
    return out.otherwise("other")


def pretokenize(c: Column) -> Column:
    """Array of (text, type): the coarse tokens, a partition of the text."""
    return F.transform(_all(c, cs.pretoken_pattern()), lambda t: F.struct(t.alias("text"), token_type(t).alias("type")))


def reject_reason(word: Column) -> Column:
    """Why a word can't be an entry; null if it can."""
    alien = F.regexp_extract(word, f"[^{cs.kind('khmer')}{cs.kind('joiner')}]", 0)
    return (
        F.when(word == "", "empty word")
        .when(alien != "", F.concat(F.lit("contains non-Khmer character "), hex_code(alien)))
        .when(is_orphan(word), "starts with a mark")
    )
