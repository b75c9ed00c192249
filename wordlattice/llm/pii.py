"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Kinds, in this order: email, ip, card, phone, iban, ssn. The first four are the
base kinds. A base span that passes its validator always counts; its score only
says how sure it is. Spans of the other kinds count from a score of 0.5.

Patterns are written so that a scan stays linear in very long texts: digit and
address runs are taken whole (possessive), never retried from their middle.
Offsets are code points, the end exclusive. A null text is an empty text.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wordlattice.llm.common import with_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
KEPT = 0.5
#: Code points on either side of a span that are searched for context words.
REACH = 40
#: Context words that raise a kind's score, and words that lower any.
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
DOUBT = ("example", "sample", "test", "version", "isbn", "order", "invoice")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of a country's IBAN.
_IBAN_SIZE = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """True if a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True if an IBAN without blanks has remainder 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping addresses, found from their @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def ibans(text: str):
    """Non-overlapping IBANs; a pattern's match may run on into what follows, so every word end in it is tried.

    The end at the country's length goes first, then the longest. Where none
    passes, the search goes on with the next word.
    """
    m = _IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        ends = [e for e in range(start + 4, m.end()) if text[e] == " "] + [m.end()]
        sized = [(e, text[start:e].replace(" ", "")) for e in reversed(ends)]
        sized.sort(key=lambda x: len(x[1]) != _IBAN_SIZE.get(x[1][:2]))
        for end, iban in sized:
            if len(iban) >= 15 and mod97(iban):
                yield start, end
                at = end
                break
        m = _IBAN.search(text, at)


def _parts_fit(ip: str) -> bool:
    return all(int(p.lstrip("0") or "0") <= 255 if len(p.lstrip("0")) <= 3 else False for p in ip.split("."))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    text = text or ""
    spans: list[tuple[str, int, int, float]] = []
    spans += [("email", s, e, _score(text, "email", s, e, 0.8)) for s, e in emails(text)]
    spans += [("ip", m.start(), m.end(), _score(text, "ip", m.start(), m.end(), 0.6)) for m in _IP.finditer(text) if _parts_fit(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end(), _score(text, "card", m.start(), m.end(), 0.9)))
    if "+" in text:
        spans += [("phone", m.start(), m.end(), _score(text, "phone", m.start(), m.end(), 0.7)) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    spans += [("iban", s, e, p) for s, e in ibans(text) if (p := _score(text, "iban", s, e, 0.8)) >= KEPT]
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and (p := _score(text, "ssn", m.start(), m.end(), 0.3)) >= KEPT:
            spans.append(("ssn", m.start(), m.end(), p))
    return spans


def _score(text: str, kind: str, start: int, end: int, prior: float) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    up = 0.3 if near.intersection(CONTEXT[kind]) else 0.0
    down = 0.3 if near.intersection(DOUBT) else 0.0
    return round(min(1.0, max(0.0, prior + up - down)), 6)


def mask(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """``text`` with each stretch of touching or overlapping spans replaced by its first kind."""
    if not text or not spans:
        return text
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join(out) + text[done:]


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``pii``: array of (kind, start, end, score), in report order."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])

    def factory():
        return lambda texts: [[[dict(zip(span.names, s, strict=True)) for s in find(t)] for t in texts]]

    return with_columns(df, [text_col], [T.StructField("pii", T.ArrayType(span))], factory)


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced by [KIND]; null stays null."""

    def factory():
        return lambda texts: [[mask(t, find(t)) for t in texts]]

    order = df.columns
    return with_columns(df, [text_col], [T.StructField(text_col, T.StringType())], factory).select(*order)


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def report(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with counts of the base kinds, a digest of base spans, and all spans as text.

    Adds n_email, n_ip, n_card, n_phone (long), base_sha256 (of the joined base
    spans; of the empty string where there are none) and spans. Null and empty
    texts have none; repeated rows stay; an empty table stays empty.
    """

    def factory():
        def compute(texts):
            out = [[] for _ in range(6)]
            for t in texts:
                spans = find(t)
                base = [s for s in spans if s[0] in BASE]
                for i, kind in enumerate(BASE):
                    out[i].append(sum(s[0] == kind for s in base))
                out[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
                out[5].append(_join(spans))
            return out

        return compute

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return with_columns(df, [text_col], fields, factory)
