"""Character classes and the patterns made of them, for Java, Python and RE2 alike.

Fixed values: the ranges below are those of the Unicode Khmer block and of the
kinds that a coarse token can have.
"""

from __future__ import annotations

COENG = "្"
LEK_TOO = "ៗ"
ZWSP = "​"
MIDDLE_DOT = "·"

#: Classes of Khmer code points, as inclusive ranges.
CLASSES: dict[str, tuple[tuple[int, int], ...]] = {
    "cons": ((0x1780, 0x17A2),),
    "indv": ((0x17A3, 0x17B3),),
    "inherent": ((0x17B4, 0x17B5),),
    "depv": ((0x17B6, 0x17C5),),
    "sign": ((0x17C6, 0x17C8),),
    "shifter": ((0x17C9, 0x17CA),),
    "robat": ((0x17CC, 0x17CC),),
    "diac": ((0x17CB, 0x17CB), (0x17CD, 0x17D1), (0x17D3, 0x17D3), (0x17DD, 0x17DD)),
    "coeng": ((0x17D2, 0x17D2),),
    "punct": ((0x17D4, 0x17D6), (0x17D8, 0x17DA)),
    "lektoo": ((0x17D7, 0x17D7),),
    "currency": ((0x17DB, 0x17DB),),
    "lettersym": ((0x17DC, 0x17DC),),
    "digit": ((0x17E0, 0x17E9),),
    "numsym": ((0x17F0, 0x17F9), (0x19E0, 0x19FF)),
    "joiner": ((0x200C, 0x200D),),
    "zwsp": ((0x200B, 0x200B),),
}
BASES = ("cons", "indv", "lettersym")
MARKS = ("inherent", "depv", "sign", "shifter", "robat", "diac", "coeng")

#: Kinds of coarse tokens in order of priority: a code point has the first that holds it.
_KINDS: dict[str, tuple[tuple[int, int], ...]] = {
    "khmer": tuple(r for c in (*BASES, *MARKS) for r in CLASSES[c]),
    "joiner": CLASSES["joiner"],
    "zwsp": CLASSES["zwsp"],
    "digit": (*CLASSES["digit"], (0x30, 0x39)),
    "punct": (
        *CLASSES["punct"], *CLASSES["lektoo"],
        *((ord(c), ord(c)) for c in "!\"#%&'()*,-./:;?@[\\]_{}¡§«¶·»¿"),
        (0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3003), (0x3008, 0x3011),
    ),
    "symbol": (
        *CLASSES["currency"], *CLASSES["numsym"], *((ord(c), ord(c)) for c in "$+<=>^`|~"),
        (0xA2, 0xA6), (0xA8, 0xAA), (0xAC, 0xB5), (0xB8, 0xBA), (0xBC, 0xBE), (0x20A0, 0x20CF), (0x2190, 0x22FF),
    ),
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x100, 0x24F), (0x1E00, 0x1EFF)),
    "space": ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)),
    "extender": ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0x1F3FB, 0x1F3FF), (0xE0020, 0xE007F), (0xE0100, 0xE01EF)),
}


def _without(ranges, taken):
    """``ranges`` less what an earlier kind has taken."""
    points = [(a, b) for a, b in ranges]
    for lo, hi in taken:
        points = [p for a, b in points for p in ((a, min(b, lo - 1)), (max(a, hi + 1), b)) if p[0] <= p[1]]
    return tuple(sorted(points))


def _in_order(kinds):
    out, taken = {}, []
    for name, ranges in kinds.items():
        out[name] = _without(ranges, taken)
        taken += out[name]
    return out


KINDS = _in_order(_KINDS)


def _escape(point: int, style: str) -> str:
    if style == "python":
        return f"\\U{point:08X}"
    return f"\\x{{{point:X}}}"


def members(*ranges: tuple[int, int], style: str = "java") -> str:
    """The inside of a character class."""
    return "".join(_escape(a, style) + (f"-{_escape(b, style)}" if b > a else "") for a, b in sorted(ranges))


def kind(*names: str, style: str = "java") -> str:
    """The inside of a character class of kinds."""
    return members(*(r for n in names for r in KINDS[n]), style=style)


def klass(*names: str, style: str = "java") -> str:
    """The inside of a character class of Khmer classes."""
    return members(*(r for n in names for r in CLASSES[n]), style=style)


def _loop(style: str) -> str:
    """The star of a group that nothing follows: possessive in Java, where a greedy one takes a stack frame for each turn and long texts end the executor."""
    return "*+" if style == "java" else "*"


def cluster_pattern(style: str = "java") -> str:
    """One orthographic cluster; all matches of a text are a partition of it."""
    base, coeng = klass(*BASES, style=style), klass("coeng", style=style)
    mark = klass(*(m for m in MARKS if m != "coeng"), "joiner", style=style)
    tail = f"(?:[{mark}]|[{coeng}]+[{base}]?){_loop(style)}"
    return f"(?s)(?:[{base}{mark}]|[{coeng}]+[{base}]?){tail}|[^{base}{mark}{coeng}]"


def pretoken_pattern(style: str = "java") -> str:
    """One coarse token; all matches of a text are a partition of it.

    RE2 has no back-references: there, runs of one punctuation mark are spelled
    out for each mark. In Python the alternatives are named groups.
    """
    k, loop = {n: kind(n, style=style) for n in KINDS}, _loop(style)
    latin = f"[{k['latin']}][{k['latin']}{k['digit']}{k['extender']}]*"
    if style == "re2":
        marks = "(?:" + "|".join(f"{_escape(p, style)}+" for a, b in KINDS["punct"] for p in range(a, b + 1)) + ")"
    elif style == "python":
        marks = f"(?P<mark>[{k['punct']}])(?P=mark)*"
    else:
        marks = f"([{k['punct']}])\\1*"
    other = "".join(k[n] for n in KINDS)
    zwj = _escape(0x200D, style)
    parts = {
        "khmer": f"[{k['khmer']}][{k['khmer']}{k['joiner']}]*",
        "number": f"[{k['digit']}]+(?:[.,:][{k['digit']}]+){loop}",
        "latin": f"{latin}(?:['{_escape(0x2019, style)}-]{latin}){loop}",
        "space": f"[{k['space']}]+|[{k['zwsp']}]+",
        "punct": marks,
        "symbol": f"[{k['symbol']}]",
        "other": f".(?:[{k['extender']}]|{zwj}[^{other}]?){loop}",
    }
    if style == "python":
        return "(?s)" + "|".join(f"(?P<{n}>{p})" for n, p in parts.items())
    return "(?s)" + "|".join(f"(?:{p})" for p in parts.values())


#: Token type by the kind of its first code point; anything else is 'other'.
TYPE_OF_KIND = {"khmer": "khmer", "digit": "number", "latin": "latin", "space": "space", "zwsp": "space", "punct": "punct", "symbol": "symbol"}
KHMER_TYPES = ("word", "unknown", "khmer")
