"""Weighted acyclic automata over words: counts of n-grams, with the count of a phrase on the arc of its last word."""

from __future__ import annotations

import numpy as np

ARC = np.dtype([("symbol", "<i4"), ("target", "<i4"), ("weight", "<i8")])


class CountTransducer:
    """An automaton that accepts n-grams of at most ``width`` words and gives every prefix the sum of the counts below it.

    ``symbols`` are its words in order. ``first[d]`` holds the first arc of every state at depth d (and the number of arcs at the end),
    ``arcs[d]`` their symbol, target (a state at depth d + 1) and weight, by state and symbol. States with equal arcs are one
    state, so tails that many n-grams share are stored once.
    """

    def __init__(self, symbols: list[bytes], first: list[np.ndarray], arcs: list[np.ndarray]):
        self.symbols, self.first, self.arcs = symbols, first, arcs

    @classmethod
    def build(cls, symbols: list[bytes], grams: np.ndarray, counts: np.ndarray) -> CountTransducer:
        """From sorted different n-grams, rows of symbol numbers that end in -1 where they are shorter."""
        width = grams.shape[1]
        n = len(grams)
        state = np.zeros(n, np.int64)        # state of each row at this depth, before equal ones are merged
        here = np.ones(n, bool)              # rows that reach this depth
        levels = []
        for d in range(width):
            longer = here & (grams[:, d] >= 0)
            at = np.flatnonzero(longer)
            if not len(at):
                break
            new = np.ones(len(at), bool)
            new[1:] = (state[at[1:]] != state[at[:-1]]) | (grams[at[1:], d] != grams[at[:-1], d])
            arc = np.cumsum(new) - 1
            weight = np.bincount(arc, counts[at]).astype(np.int64) if counts.sum() < 1 << 52 else _exact(arc, counts[at])
            starts = at[new]
            levels.append((state[starts], grams[starts, d].astype(np.int64), weight, int(state[here].max()) + 1))
            state = np.zeros(n, np.int64)
            state[at] = arc
            here = longer
        first, arcs = [], []
        merged = np.zeros(len(levels[-1][0]) if levels else 0, np.int64)   # the deepest states have no arcs: one state
        for source, symbol, weight, states in reversed(levels):
            table = np.empty(len(source), ARC)
            table["symbol"], table["target"], table["weight"] = symbol, merged, weight
            bounds = np.searchsorted(source, np.arange(states + 1))
            merged, kept = _register(table, bounds)
            first.append(np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64))
            arcs.append(np.concatenate(kept) if kept else np.empty(0, ARC))
        return cls(symbols, first[::-1], arcs[::-1])

    def to_bytes(self) -> bytes:
        names = b" ".join(self.symbols)
        sizes = [len(self.symbols), len(names), len(self.arcs)]
        sizes += [v for f, a in zip(self.first, self.arcs) for v in (len(f), len(a))]
        parts = [np.array(sizes, "<i8").tobytes(), names]
        parts += [b for f, a in zip(self.first, self.arcs) for b in (f.astype("<i8").tobytes(), a.tobytes())]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountTransducer:
        head = np.frombuffer(raw, "<i8", 3)
        sizes = np.frombuffer(raw, "<i8", 2 * int(head[2]), 24).tolist()
        at = 24 + 8 * len(sizes)
        names = raw[at : at + int(head[1])]
        at += int(head[1])
        first, arcs = [], []
        for k in range(int(head[2])):
            first.append(np.frombuffer(raw, "<i8", sizes[2 * k], at))
            at += 8 * sizes[2 * k]
            arcs.append(np.frombuffer(raw, ARC, sizes[2 * k + 1], at))
            at += ARC.itemsize * sizes[2 * k + 1]
        return cls(names.split(b" ") if head[0] else [], first, arcs)

    def prefixes(self, width: int):
        """Per depth: the rows of symbols of all prefixes (padded with -1) in order, and their weights."""
        rows, state = np.full((1, width), -1, np.int32), np.zeros(1, np.int64)
        for d, (first, arcs) in enumerate(zip(self.first, self.arcs)):
            rows, state, found = self._step(rows, state, first, arcs)
            rows[:, d] = found["symbol"]
            yield rows, found["weight"]
            if d + 1 < len(self.first):
                has = self.first[d + 1][state + 1] > self.first[d + 1][state]
                rows, state = rows[has], state[has]

    @staticmethod
    def _step(rows, state, first, arcs):
        much = first[state + 1] - first[state]
        of = np.repeat(np.arange(len(state)), much)
        place = np.arange(len(of)) - np.repeat(np.cumsum(much) - much, much) + first[state][of]
        found = arcs[place]
        return rows[of].copy(), found["target"].astype(np.int64), found

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams and their own counts: the weight of a prefix less that of its continuations."""
        levels = list(self.prefixes(width))
        out, own = [], []
        for d, (rows, weight) in enumerate(levels):
            if d + 1 < len(levels):
                below_rows, below = levels[d + 1]
                rest = weight.copy()
                parents = _row_numbers(rows[:, : d + 1], below_rows[:, : d + 1])
                np.subtract.at(rest, parents, below)
            else:
                rest = weight
            out.append(rows[rest > 0])
            own.append(rest[rest > 0])
        if not out:
            return np.empty((0, width), np.int32), np.empty(0, np.int64)
        rows, own = np.concatenate(out), np.concatenate(own)
        order = np.lexsort(rows.T[::-1])
        return rows[order], own[order]

    @classmethod
    def union(cls, parts: list[CountTransducer], width: int) -> CountTransducer:
        """The automaton of the summed counts of all parts."""
        symbols, rows, counts = cls.summed(parts, width)
        return cls.build(symbols, rows, counts)

    @classmethod
    def summed(cls, parts: list[CountTransducer], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(symbols, sorted n-grams, counts) of all parts together."""
        symbols = sorted(set().union(*(p.symbols for p in parts))) if parts else []
        number = {w: k for k, w in enumerate(symbols)}
        rows, counts = [np.empty((0, width), np.int32)], [np.empty(0, np.int64)]
        for part in parts:
            found, own = part.grams(width)
            rename = np.array([number[w] for w in part.symbols] + [-1], np.int32)   # -1 stays -1
            rows.append(rename[found])
            counts.append(own)
        return symbols, *count_rows(np.concatenate(rows), np.concatenate(counts))

    def compose(self, asked: CountTransducer) -> list[tuple[bytes, int]]:
        """(phrase, weight here) of the n-grams that ``asked`` accepts, by walking both automata in step.

        Phrases that lead nowhere here are left out. ``asked`` has a weight of its own on each n-gram that is asked for.
        """
        number = {w: k for k, w in enumerate(self.symbols)}
        rename = np.array([number.get(w, -1) for w in asked.symbols] + [-1], np.int64)
        width = len(asked.arcs)
        rows = np.full((1, width), -1, np.int32)
        left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
        out = []
        for d in range(min(width, len(self.arcs))):
            much = asked.first[d][left + 1] - asked.first[d][left]
            of = np.repeat(np.arange(len(left)), much)
            place = np.arange(len(of)) - np.repeat(np.cumsum(much) - much, much) + asked.first[d][left][of]
            arc = asked.arcs[d][place]
            symbol = rename[arc["symbol"]]
            source = right[of]
            keys = np.repeat(np.arange(len(self.first[d]) - 1), np.diff(self.first[d])) * len(self.symbols) + self.arcs[d]["symbol"]
            want = source * len(self.symbols) + symbol
            hit = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            good = (symbol >= 0) & (keys[hit] == want)
            rows = rows[of][good]
            rows[:, d] = arc["symbol"][good]
            left, right = arc["target"][good].astype(np.int64), self.arcs[d]["target"][hit[good]].astype(np.int64)
            weight = self.arcs[d]["weight"][hit[good]]
            below = np.zeros(len(left), np.int64)
            if d + 1 < width:
                sums = np.concatenate([[0], np.cumsum(asked.arcs[d + 1]["weight"])])
                below = sums[asked.first[d + 1][left + 1]] - sums[asked.first[d + 1][left]]
            ends = arc["weight"][good] > below
            out += [
                (b" ".join(asked.symbols[s] for s in row[: d + 1]), int(w)) for row, w in zip(rows[ends].tolist(), weight[ends])
            ]
            if d + 1 < min(width, len(self.arcs)):
                more = below > 0
                rows, left, right = rows[more], left[more], right[more]
        return out


def count_rows(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows with their summed counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
    return rows[new], np.add.reduceat(counts, np.flatnonzero(new))


def _exact(arc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(int(arc[-1]) + 1, np.int64)
    np.add.at(total, arc, counts)
    return total


def _row_numbers(sorted_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each of ``rows`` (sorted, with repeats) stands among ``sorted_rows``, some of which are skipped."""
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.empty(0, bool)
    seen = rows[new]
    both = np.concatenate([sorted_rows, seen])
    order = np.lexsort((np.arange(len(both)) >= len(sorted_rows), *both.T[::-1]))
    owner = np.cumsum(order < len(sorted_rows)) - 1
    place = np.empty(len(both), np.int64)
    place[order] = owner
    return place[len(sorted_rows) :][np.cumsum(new) - 1] if len(rows) else np.empty(0, np.int64)


def _register(table: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """State numbers with equal arc lists merged, and the arcs of each merged state, in the order of first appearance."""
    known: dict[bytes, int] = {}
    kept, number = [], np.empty(len(bounds) - 1, np.int64)
    raw, size, edges = table.tobytes(), ARC.itemsize, bounds.tolist()
    for k in range(len(edges) - 1):
        key = raw[edges[k] * size : edges[k + 1] * size]
        value = known.get(key)
        if value is None:
            value = known[key] = len(kept)
            kept.append(table[edges[k] : edges[k + 1]])
        number[k] = value
    return number, kept
