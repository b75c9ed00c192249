"""Plain-Python text kernels, used inside Arrow functions."""

from __future__ import annotations

import re
from functools import lru_cache

from wordlattice.functions import charsets as cs

CLUSTER = re.compile(cs.cluster_pattern("python"))
PRETOKEN = re.compile(cs.pretoken_pattern("python"))
_BASE = re.compile(f"[{cs.klass(*cs.BASES, style='python')}]")
_MARK = re.compile(f"[{cs.klass(*cs.MARKS, style='python')}]")
_JOINING = re.compile(f"[{cs.klass(*cs.MARKS, 'joiner', style='python')}]")
_UNIT = re.compile(f"(?s){cs.COENG}[{cs.klass('cons', 'indv', style='python')}]|.")
_STOP = re.compile(f"{cs.COENG}(?![{cs.klass('cons', 'indv', style='python')}])")
RO = "រ"
#: Place of a single mark within a cluster; a COENG pair has 2, all others 6.
SLOTS = {"robat": 1, "shifter": 3, "joiner": 4, "depv": 5}
_SLOT = {chr(p): s for c, s in SLOTS.items() for a, b in cs.CLASSES[c] for p in range(a, b + 1)}
_CLASS = {chr(p): c for c, ranges in cs.CLASSES.items() for a, b in ranges for p in range(a, b + 1)}


def has_marks(text: str) -> bool:
    """Does a text have marks or joiners, so that a cluster may have many code points?"""
    return _JOINING.search(text) is not None


def clusters(text: str) -> list[str]:
    """The clusters of a text, in order; without marks and joiners each code point is one."""
    return CLUSTER.findall(text) if _JOINING.search(text) else list(text)


def is_orphan(cluster: str) -> bool:
    """Does a cluster begin with a mark or joiner?"""
    c = _CLASS.get(cluster[:1])
    return c in cs.MARKS or c == "joiner"


@lru_cache(1 << 16)
def normalize_cluster(cluster: str) -> str:
    """A cluster with its marks in canonical order, inherent vowels and repeated marks dropped."""
    if len(cluster) < 2 or not _BASE.match(cluster) or _STOP.search(cluster):
        return cluster
    units = [u for u in _UNIT.findall(cluster[1:]) if _CLASS.get(u) != "inherent"]
    units.sort(key=lambda u: (2, u[1] == RO) if len(u) == 2 else (_SLOT.get(u, 6), False))
    out, last = [cluster[0]], None
    for u in units:
        if len(u) == 2 or u != last:
            out.append(u)
            last = u
    return "".join(out)


def normalize(text: str) -> str:
    """normalize_cluster() over all clusters."""
    return "".join(map(normalize_cluster, clusters(text)))


def pretokenize(text: str) -> list[tuple[str, str]]:
    """(text, type) of the coarse tokens."""
    return [(m.group(), m.lastgroup) for m in PRETOKEN.finditer(text)]


def cluster_issues(text: str) -> list[tuple[int, str]]:
    """(offset, kind) of what is wrong with the clusters of a text."""
    found, place = [], 0
    for cluster in clusters(text):
        first = _CLASS.get(cluster[0])
        if first in cs.MARKS or first == "joiner":
            found.append((place, "orphan-mark"))
        elif first in cs.BASES:
            found += _in_cluster(cluster, place)
        place += len(cluster)
    return found


def _in_cluster(cluster: str, place: int) -> list[tuple[int, str]]:
    found, slot, pairs, vowels, seen, at = [], 0, 0, 0, set(), 1
    for unit in _UNIT.findall(cluster[1:]):
        here, c = place + at, _CLASS.get(unit[0])
        at += len(unit)
        if unit == cs.COENG:
            found.append((here, "dangling-coeng"))
        elif len(unit) == 2:
            pairs += 1
            if pairs > 2:
                found.append((here, "too-many-subscripts"))
            if slot > 2:
                found.append((here, "out-of-order"))
            slot = max(slot, 2)
        elif c == "inherent":
            found.append((here, "inherent-vowel"))
        else:
            if c != "joiner" and unit in seen:
                found.append((here, "duplicate-mark"))
                continue
            seen.add(unit)
            mine = _SLOT.get(unit, 6)
            if c == "depv":
                vowels += 1
                if vowels > 1:
                    found.append((here, "multiple-vowels"))
            if mine < slot:
                found.append((here, "out-of-order"))
            slot = max(slot, mine)
    return found
