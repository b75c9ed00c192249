"""Path search through one run of clusters.

A piece is (from, to, entry) in cluster numbers; entry is None for an unknown
cluster. Words begin and end on cluster boundaries, as they are looked up by the
text of whole clusters.
"""

from __future__ import annotations

from collections.abc import Iterable
from copy import copy
from itertools import islice

import numpy as np

from wordlattice.functions import kernels

ALGORITHMS = ("viterbi", "fmm", "bmm", "bimm")
#: Costs this close count as equal; then the path of fewer pieces wins.
EPSILON = 1e-9
_FAR = float("inf")

Piece = tuple[int, int, int | None]
#: Runs that are searched in step, at least; fewer ones are searched one by one.
TOGETHER = 32


_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


class Trie:
    """Words as sequences of symbols (small integers) in flat arrays, looked up for many places at once.

    A step from node to node is the number node * symbols + symbol. Nodes are
    numbered by depth, and the steps of the first depths, which most look-ups end
    in, are places of a plain table with at most as many places as there are
    nodes. All others are in a hash table with linear probing: twelve bytes a slot,
    1.5 slots and a hit a node; eight bytes a slot if the numbers of steps allow. So 16
    to 26 bytes for each node, 85 at most for each entry of a large lexicon.
    """

    def __init__(self, symbols: int, flat: np.ndarray, starts: np.ndarray):
        """Word i is flat[starts[i]:starts[i + 1]]; of equal words the last one counts."""
        self.symbols = symbols
        sizes, node, levels, nodes, depth = np.diff(starts), np.zeros(len(starts) - 1, np.int32), [], 1, 0
        kind = np.int32 if (len(flat) + 1) * symbols < 1 << 31 else np.int64
        alive = np.flatnonzero(sizes > 0)
        while len(alive):
            keys, at = np.unique(node[alive].astype(kind) * kind(symbols) + flat[starts[alive] + depth].astype(kind), return_inverse=True)
            node[alive] = nodes + at
            levels.append(keys)
            nodes, depth = nodes + len(keys), depth + 1
            alive = alive[sizes[alive] > depth]
        firsts = np.cumsum([1, *map(len, levels)]).tolist()
        self.plain = sum(end * symbols <= nodes for end in firsts[:-1])  # depths whose steps are in the table
        self.table = np.zeros(firsts[self.plain - 1] * symbols if self.plain else 0, np.int32)
        hashed = nodes - firsts[self.plain]
        self.slots = hashed + hashed // 2 + 8
        self.keys, self.to = np.full(self.slots, -1, kind), np.zeros(self.slots, np.int32)
        for depth, keys in enumerate(levels):
            levels[depth] = None
            to = np.arange(firsts[depth], firsts[depth] + len(keys), dtype=np.int32)
            if depth < self.plain:
                self.table[keys] = to
            else:
                self._put(keys, to)
        self.hits = np.full(nodes, -1, np.int32)
        self.hits[node] = np.arange(len(node), dtype=np.int32)
        self.hits[0] = -1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys.astype(np.uint64) * _ODD) >> _HALF) * np.uint64(self.slots) >> _HALF).astype(np.int64)

    def _put(self, keys: np.ndarray, to: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of those that meet in a slot one stays
            mine = self.keys[slot] == keys
            self.to[slot[mine]] = to[mine]
            keys, to, slot = keys[~mine], to[~mine], (slot[~mine] + 1) % self.slots

    def step(self, nodes: np.ndarray, symbols: np.ndarray, depth: int) -> np.ndarray:
        """The node behind each node of a depth by its symbol; 0 if there is none."""
        keys = nodes * np.int64(self.symbols) + symbols
        if depth < self.plain:
            return self.table[keys]
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], 0)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.slots
            there = self.keys[slot[open_]]
            found = there == keys[open_]
            out[open_[found]] = self.to[slot[open_[found]]]
            open_ = open_[~found & (there >= 0)]
        return out

    def edges(self, symbols: np.ndarray, stops: np.ndarray):
        """(places, size, words) for each size: all words that begin at a place and end by its stop."""
        place, node, size = np.arange(len(symbols)), np.zeros(len(symbols), np.int32), 0
        while len(place):
            node = self.step(node, symbols[place + size], size)
            on = np.flatnonzero(node)
            place, node, size = place[on], node[on], size + 1
            hit = self.hits[node]
            if len(real := np.flatnonzero(hit >= 0)):
                yield place[real], size, hit[real]
            more = np.flatnonzero(place + size < stops[place])
            place, node = place[more], node[more]

    def longest(self, symbols: np.ndarray, stops: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Size of the longest word that begins at each of some places and ends by its stop; 0 if there is none."""
        out = np.zeros(len(places), np.int64)
        at, node, size = np.arange(len(places)), np.zeros(len(places), np.int32), 0
        while len(at):
            node = self.step(node, symbols[places[at] + size], size)
            on = np.flatnonzero(node)
            at, node, size = at[on], node[on], size + 1
            out[at[self.hits[node] >= 0]] = size
            more = np.flatnonzero(places[at] + size < stops[at])
            at, node = at[more], node[more]
        return out


class Decoder:
    """A lexicon ready for look-up on an executor: some 85 bytes for each entry."""

    def __init__(self, unknown_cost: float, algorithm: str, symbol: dict[str, int], trie: Trie, entry: np.ndarray, cost: np.ndarray):
        self.unknown_cost, self.algorithm, self.symbol, self.trie, self.entry, self.cost = unknown_cost, algorithm, symbol, trie, entry, cost
        # symbols by code point, for clusters of one; the last one stands for all that follow
        single = {ord(c): i for c, i in symbol.items() if len(c) == 1}
        self.points = np.full(max(single, default=0) + 2, len(symbol), np.int64)
        self.points[list(single)] = list(single.values())

    @classmethod
    def of(cls, words: dict[str, tuple[int, float]], unknown_cost: float, algorithm: str = "viterbi") -> Decoder:
        return cls.of_columns(words, [e for e, _ in words.values()], [c for _, c in words.values()], unknown_cost, algorithm)

    @classmethod
    def of_columns(cls, words: Iterable[str], entries, costs, unknown_cost: float, algorithm: str = "viterbi") -> Decoder:
        """From words, their entries and their costs."""
        return cls.of_batches([(words, entries, costs)], unknown_cost, algorithm)

    @classmethod
    def of_batches(cls, batches: Iterable[tuple], unknown_cost: float, algorithm: str = "viterbi") -> Decoder:
        """From batches of words, their entries and their costs, of which one at a time is held as objects."""
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {algorithm!r}")
        symbol: dict[str, int] = {}
        flat, sizes, entry, cost = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for words, entries, costs in batches:
            words = iter(words)
            while some := list(islice(words, 50_000)):
                parts = list(map(kernels.clusters, some)) if (text := "".join(some)) and kernels.has_marks(text) else some
                sizes.append(np.array(list(map(len, parts)), np.int64))
                if parts is some:  # each cluster is one code point
                    points, at = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
                    ids = np.array([symbol.setdefault(chr(p), len(symbol)) for p in points.tolist()], np.int32)[at]
                else:
                    ids = np.array([symbol.setdefault(c, len(symbol)) for part in parts for c in part], np.int32)
                flat.append(ids.astype(np.uint16) if len(symbol) < 1 << 16 else ids)
            number = np.asarray(entries, np.int64)
            entry.append(number.astype(np.int32) if not len(number) or number.max() < 1 << 31 else number)
            cost.append(np.asarray(costs, np.float64))
        starts, flat, entry, cost = np.cumsum(np.concatenate(sizes)), np.concatenate(flat), np.concatenate(entry), np.concatenate(cost)
        # the last symbol stands for clusters that no word has
        return cls(unknown_cost, algorithm, symbol, Trie(len(symbol) + 1, flat, starts), entry, cost)

    def like(self, unknown_cost: float, algorithm: str) -> Decoder:
        """The same words, searched in another way."""
        out = copy(self)
        out.unknown_cost, out.algorithm = unknown_cost, algorithm
        return out

    def known(self, words: list[str]) -> np.ndarray:
        """Which words, of canonical spelling, the lexicon has."""
        symbols, stops, bounds = self._laid_out([kernels.clusters(w) for w in words] if kernels.has_marks("".join(words)) else words)
        some = np.flatnonzero(np.diff(bounds) > 0)
        out = np.zeros(len(words), bool)
        out[some] = self.trie.longest(symbols, bounds[some + 1], bounds[some]) == np.diff(bounds)[some]
        return out

    def _laid_out(self, runs: list[list[str]] | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all runs, the place behind each symbol's run, and the runs' bounds."""
        get, other = self.symbol.get, len(self.symbol)
        sizes = np.array([len(run) for run in runs], np.int64)
        text = "".join(["".join(run) for run in runs])
        if len(text) == sizes.sum():  # each cluster is one code point
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = self.points[np.minimum(points, len(self.points) - 1)]
        else:
            symbols = np.array([get(c, other) for run in runs for c in run], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return symbols, np.repeat(bounds[1:], sizes), bounds

    def pieces(self, clusters: list[str]) -> list[Piece]:
        """The chosen path, unknown clusters one by one."""
        return self.many([clusters])[0]

    def many(self, runs: list[list[str]]) -> list[list[Piece]]:
        """The chosen path of each run."""
        symbols, stops, bounds = self._laid_out(runs)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        if self.algorithm == "viterbi":
            return [self._trace(back) for _, _, back in self._tables(symbols, stops, spans)]
        ahead, behind = self.algorithm != "bmm", self.algorithm in ("bmm", "bimm")
        n = len(symbols)
        # the longest word from each place, and to each; longer ones come later
        size, word = np.ones((2, n), np.int64), np.full((2, n), -1, np.int64)
        for place, length, hit in self.trie.edges(symbols, stops):
            if ahead:
                size[0, place], word[0, place] = length, hit
            if behind:
                size[1, place + length - 1], word[1, place + length - 1] = length, hit
        sizes, entries = size.tolist(), [self._entries(w) for w in word]
        one = [self._forward(sizes[0], entries[0], a, b) for a, b in spans] if ahead else []
        two = [self._backward(sizes[1], entries[1], a, b) for a, b in spans] if behind else []
        if ahead and behind:
            return [x if self._score(x) < self._score(y) else y for x, y in zip(one, two, strict=True)]
        return one or two

    def ends(self, symbols: np.ndarray, bounds: np.ndarray, plans: list[tuple[str, float, bool]]) -> list[np.ndarray]:
        """For each (algorithm, unknown cost, merging) the places that a piece of the path ends with, of runs laid out side by side.

        The paths of many(), without entries: all runs are searched in step, and
        what several plans need is made once.
        """
        stops = np.repeat(bounds[1:], np.diff(bounds))
        found = None if all(a == "fmm" for a, _, _ in plans) else list(self.trie.edges(symbols, stops))
        made: dict = {}
        laid = self._in_step(found, bounds, len(symbols)) if any(a == "viterbi" for a, _, _ in plans) else None

        def path(algorithm: str, unknown: float) -> tuple[np.ndarray, np.ndarray]:
            key = (algorithm, unknown if algorithm == "viterbi" else None)
            if key not in made:
                if algorithm == "bimm":
                    made[key] = self._better(path("fmm", unknown), path("bmm", unknown), bounds)
                elif algorithm == "fmm" and found is None:
                    made[key] = self._greedy(symbols, stops, bounds)
                elif algorithm == "viterbi":
                    made[key] = self._jumps(self._last_sizes(laid, unknown), bounds, True)
                else:
                    sizes = np.zeros(len(symbols), np.int64)
                    for place, size, _ in found:
                        sizes[place if algorithm == "fmm" else place + size - 1] = size
                    made[key] = self._jumps(sizes, bounds, algorithm == "bmm")
            return made[key]

        out = []
        for algorithm, unknown, merge in plans:
            end, alone = path(algorithm, unknown)
            if merge:
                joined = alone[:-1] & alone[1:]
                joined[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(symbols))] - 1] = False
                end = end.copy()
                end[:-1] &= ~joined
            out.append(end)
        return out

    @staticmethod
    def _jumps(sizes: np.ndarray, bounds: np.ndarray, backward: bool, done: tuple | None = None, at: np.ndarray | None = None, run: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ends of pieces, those that are an unknown cluster) by the size of the piece at each place, 0 for an unknown cluster.

        Backward, sizes are those of pieces that end with their places. ``done``,
        ``at`` and ``run`` have what is found so far and where runs go on.
        """
        end, alone = done or (np.zeros(len(sizes), bool), np.zeros(len(sizes), bool))
        run = np.flatnonzero(np.diff(bounds) > 0) if run is None else run
        at = (bounds[run + 1] - 1 if backward else bounds[run]) if at is None else at
        goal = bounds[run] if backward else bounds[run + 1] - 1
        while len(at) >= TOGETHER:
            size = sizes[at]
            step = np.maximum(size, 1)
            last = at if backward else at + step - 1
            end[last], alone[last] = True, size == 0
            at = at - step if backward else at + step
            more = np.flatnonzero(at >= goal if backward else at <= goal)
            at, goal = at[more], goal[more]
        for a, g in zip(at.tolist(), goal.tolist(), strict=True):
            low, high = (g, a) if backward else (a, g)
            mine, ends, ones = sizes[low : high + 1].tolist(), [], []
            while low <= a <= high:
                size = mine[a - low]
                step = size or 1
                ends.append(a if backward else a + step - 1)
                if not size:
                    ones.append(ends[-1])
                a = a - step if backward else a + step
            end[ends] = True
            alone[ones] = True
        return end, alone

    def _greedy(self, symbols: np.ndarray, stops: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_jumps() of the longest words ahead, which are looked up only where a piece begins."""
        end, alone = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
        run = np.flatnonzero(np.diff(bounds) > 0)
        at = bounds[run]
        while len(at) >= TOGETHER:
            size = self.trie.longest(symbols, bounds[run + 1], at)
            step = np.maximum(size, 1)
            last = at + step - 1
            end[last], alone[last] = True, size == 0
            at = at + step
            more = np.flatnonzero(at < bounds[run + 1])
            at, run = at[more], run[more]
        sizes = np.zeros(len(symbols), np.int64)
        for a, b in zip(at.tolist(), bounds[run + 1].tolist(), strict=True):
            for place, size, _ in self.trie.edges(symbols[a:b], np.full(b - a, b - a)):
                sizes[place + a] = size
        return self._jumps(sizes, bounds, False, (end, alone), at, run)

    @staticmethod
    def _better(ahead: tuple, behind: tuple, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of two paths of each run the one with the lower _score(), else the second."""
        run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        scores = []
        for end, alone in (ahead, behind):
            single = end & ~alone
            single[1:] &= end[:-1] | (run[1:] != run[:-1])
            scores.append([np.bincount(run[x], minlength=len(bounds) - 1) for x in (end, alone, single)])
        (n, u, w), (m, v, x) = scores
        first = ((n < m) | (n == m) & ((u < v) | (u == v) & (w < x)))[run]
        return np.where(first, ahead[0], behind[0]), np.where(first, ahead[1], behind[1])

    def _in_step(self, found: list, bounds: np.ndarray, n: int) -> tuple:
        """Edges laid out for _last_sizes(), which several unknown costs share.

        Runs are dealt with from the longest to the shortest, so that those which
        reach a place are the first ones; cell[p] + r is place p of the r-th of them.
        The few longest are searched one by one.
        """
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        reach = int(lengths[order[TOGETHER - 1]]) if len(order) >= TOGETHER else 0
        spans = [(int(bounds[r]), int(bounds[r + 1])) for r in order[lengths[order] > reach]]
        inside = np.zeros(n, bool)
        for a, b in spans:
            inside[a:b] = True
        apart = self._sorted([(p[k], size, h[k]) for p, size, h in found for k in [inside[p]]], n) if spans else None
        order = order[(lengths[order] <= reach) & (lengths[order] > 0)]
        active = len(order) - np.searchsorted(lengths[order][::-1], np.arange(reach), side="right")
        cell = np.concatenate(([0], np.cumsum(active)))
        begin = bounds[order]
        flat = np.concatenate([np.zeros(0, np.int64), *(begin[:a] + p for p, a in enumerate(active.tolist()))])  # the place of each cell
        cells = np.full(n, -1, np.int32)
        cells[flat] = np.arange(len(flat), dtype=np.int32)
        edges = []
        for place, size, hit in found if len(flat) else ():
            mine = cells[place]
            by = np.argsort(mine)
            by = by[np.searchsorted(mine[by], 0) :]
            mine = mine[by]
            edges.append((size, mine, self.cost[hit[by]], np.searchsorted(mine, cell).tolist()))
        return n, spans, apart, flat, cell.tolist(), active.tolist(), edges

    def _last_sizes(self, laid: tuple, unknown: float) -> np.ndarray:
        """Size of the last piece of the cheapest path to the end of each place, 0 for an unknown cluster; see _tables()."""
        n, spans, apart, flat, at, many, edges = laid
        out = np.zeros(n, np.int64)
        for (a, b), (_, _, back) in zip(spans, self._filled(apart, spans, unknown) if spans else (), strict=True):
            out[a:b] = [0 if entry is None else e + 1 - p for e, (p, entry) in enumerate(back[1:])]
        cost, count, back = np.full(len(flat), _FAR), np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)
        for p, a in enumerate(many):
            before = at[p - 1] if p else 0
            here = cost[before : before + a] if p else np.zeros(a)
            pieces = count[before : before + a] + 1 if p else np.ones(a, np.int32)
            for size, mine, prices, cuts in edges:
                i, j = cuts[p], cuts[p + 1]
                if i == j:
                    continue
                r = mine[i:j] - at[p]
                to = r + at[p + size - 1]
                c, new, old = here[r] + prices[i:j], pieces[r], cost[to]
                won = np.flatnonzero((c < old - EPSILON) | ((c <= old + EPSILON) & (new < count[to])))
                to = to[won]
                cost[to], count[to], back[to] = c[won], new[won], size
            own = slice(at[p], at[p] + a)
            c, old = here + unknown, cost[own]
            won = np.flatnonzero((c < old - EPSILON) | ((c <= old + EPSILON) & (pieces < count[own])))
            to = won + at[p]
            cost[to], count[to], back[to] = c[won], pieces[won], 0
        out[flat] = back
        return out

    def _entries(self, words: np.ndarray) -> list[int | None]:
        """Entries of words, None for -1."""
        out = self.entry[words].tolist() if len(self.entry) else [None] * len(words)
        for i in np.flatnonzero(words < 0).tolist():
            out[i] = None
        return out

    @staticmethod
    def _score(path: list[Piece]) -> tuple[int, int, int]:
        """Pieces, unknown pieces, one-cluster words: fewer are better."""
        return len(path), sum(e is None for _, _, e in path), sum(e is not None and b - a == 1 for a, b, e in path)

    @staticmethod
    def _forward(sizes: list[int], entries: list[int | None], a: int, b: int) -> list[Piece]:
        """From the start, the longest word at each place."""
        out, p = [], a
        while p < b:
            q = p + sizes[p]
            out.append((p - a, q - a, entries[p]))
            p = q
        return out

    @staticmethod
    def _backward(sizes: list[int], entries: list[int | None], a: int, b: int) -> list[Piece]:
        """From the end, the longest word that ends at each place."""
        out, e = [], b
        while e > a:
            p = e - sizes[e - 1]
            out.append((p - a, e - a, entries[e - 1]))
            e = p
        return out[::-1]

    def _tables(self, symbols: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]):
        """For each run the cheapest cost of each boundary, pieces to it, and the last piece (from, entry).

        Edges leave boundaries from left to right, shorter words first, the
        unknown cluster last. An edge wins if it is cheaper by more than EPSILON,
        or no dearer than that and of fewer pieces; so the order counts.
        """
        return self._filled(self._sorted(list(self.trie.edges(symbols, stops)), len(symbols)), spans, self.unknown_cost)

    def _sorted(self, found: list, n: int) -> tuple[list, list, list, list]:
        """(first edge of each of n places, ends, prices, entries) of edges, by place and size."""
        none = np.zeros(0, np.int64)
        places = np.concatenate([none, *(p for p, _, _ in found)])
        order = np.argsort(places, kind="stable")  # sizes stay in order
        sizes = np.concatenate([none, *(np.full(len(p), k) for p, k, _ in found)])[order]
        hits = np.concatenate([none, *(h for _, _, h in found)])[order]
        places = places[order]
        begins = np.searchsorted(places, np.arange(n + 1)).tolist()
        return begins, (places + sizes).tolist(), self.cost[hits].tolist(), self.entry[hits].tolist()

    @staticmethod
    def _filled(edges: tuple[list, list, list, list], spans: list[tuple[int, int]], unknown: float):
        """_tables() of the runs at some bounds, by _sorted() edges."""
        begins, ends, prices, entries = edges
        for a, b in spans:
            size = b - a
            cost, count, back = [0.0] + [_FAR] * size, [0] * (size + 1), [(0, None)] * (size + 1)
            for p in range(size):
                here, pieces = cost[p], count[p] + 1
                for k in range(begins[a + p], begins[a + p + 1]):
                    c, q = here + prices[k], ends[k] - a
                    if c < cost[q] - EPSILON or (c <= cost[q] + EPSILON and pieces < count[q]):
                        cost[q], count[q], back[q] = c, pieces, (p, entries[k])
                c, q = here + unknown, p + 1
                if c < cost[q] - EPSILON or (c <= cost[q] + EPSILON and pieces < count[q]):
                    cost[q], count[q], back[q] = c, pieces, (p, None)
            yield cost, count, back

    def table(self, clusters: list[str]) -> tuple[list[float], list[int], list[tuple[int, int | None]]]:
        """The table of one run."""
        symbols, stops, _ = self._laid_out([clusters])
        return next(self._tables(symbols, stops, [(0, len(clusters))]))

    @staticmethod
    def _trace(back: list[tuple[int, int | None]]) -> list[Piece]:
        """The cheapest path, from the last pieces of its boundaries."""
        out, e = [], len(back) - 1
        while e:
            p, entry = back[e]
            out.append((p, e, entry))
            e = p
        return out[::-1]

    def sums(self, runs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Number and cost of all words in each run."""
        symbols, stops, bounds = self._laid_out(runs)
        number, cost = np.zeros(len(symbols), np.int64), np.zeros(len(symbols))
        for place, _, hit in self.trie.edges(symbols, stops):
            number[place] += 1
            cost[place] += self.cost[hit]
        run = np.repeat(np.arange(len(runs)), np.diff(bounds))
        return np.bincount(run, number, len(runs)).astype(np.int64), np.bincount(run, cost, len(runs))
