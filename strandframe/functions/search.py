"""Exact search kernels over the five-letter alphabet: finite automaton, Horspool, transfer functions."""

from __future__ import annotations

import numpy as np

ALPHABET = "ACGTN"
_CODE = np.full(256, 4, np.uint8)
for _i, _x in enumerate(ALPHABET):
    _CODE[ord(_x)] = _CODE[ord(_x.lower())] = _i


def encode(seq: str) -> np.ndarray:
    """0..4 for ACGTN in either case; anything else is N."""
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def automaton(pattern: str) -> np.ndarray:
    """(m + 1) x 5 table: next state = matched prefix length; state m is the hit."""
    p = encode(pattern)
    if not len(p):
        raise ValueError("empty pattern")
    table = np.zeros((len(p) + 1, 5), np.int32)
    table[0, p[0]] = 1
    border = 0
    for k in range(1, len(p) + 1):
        table[k] = table[border]
        if k < len(p):
            border = table[border, p[k]]
            table[k, p[k]] = k + 1
    return table


def find_dfa(seq: str, pattern: str) -> list[int]:
    table, m, state, out = automaton(pattern).tolist(), len(pattern), 0, []
    for i, x in enumerate(encode(seq).tolist()):
        state = table[state][x]
        if state == m:
            out.append(i - m + 1)
    return out


def find_horspool(seq: str, pattern: str) -> list[int]:
    s, p = encode(seq).tobytes(), encode(pattern).tobytes()
    m, out = len(p), []
    if not m:
        raise ValueError("empty pattern")
    shift = {x: m - 1 - i for i, x in enumerate(p[:-1])}
    at = 0
    while at + m <= len(s):
        if s[at : at + m] == p:
            out.append(at)
        at += shift.get(s[at + m - 1], m)
    return out


def find(seq: str, pattern: str) -> list[int]:
    """All overlapping hits by the library's substring search."""
    out, at = [], seq.find(pattern)
    while at >= 0:
        out.append(at)
        at = seq.find(pattern, at + 1)
    return out


class Transfer:
    """Effect of a chunk on the automaton: where each state ends, how many hits on the way. Composition is
    associative, so chunks are handled apart and folded in order."""

    __slots__ = ("hits", "to")

    def __init__(self, to: np.ndarray, hits: np.ndarray):
        self.to, self.hits = to, hits

    @classmethod
    def of(cls, table: np.ndarray, chunk: np.ndarray) -> "Transfer":
        to, hits = np.arange(len(table)), np.zeros(len(table), np.int64)
        for x in chunk.tolist():
            to = table[to, x]
            hits += to == len(table) - 1
        return cls(to, hits)

    def then(self, other: "Transfer") -> "Transfer":
        return Transfer(other.to[self.to], self.hits + other.hits[self.to])


def transfers(table: np.ndarray, x: np.ndarray, chunk: int, cells: int = 1 << 22):
    """(state after it, hits on the way) from each state, as lists, of each chunk of ``x``: letters are transfers, and neighbours are folded in
    pairs, all chunks of about ``cells`` cells side by side."""
    states, width = len(table), 1 << (chunk - 1).bit_length()
    step = max(1, cells // (width * states)) * chunk
    for lo in range(0, len(x), step):
        own = x[lo : lo + step]
        n = -(-len(own) // chunk)
        to = np.broadcast_to(np.arange(states, dtype=np.int32), (n * chunk, states)).copy()  # places after the end change nothing
        to[: len(own)] = table.T[own]
        hits = np.zeros((n * chunk, states), np.int32)
        hits[: len(own)] = to[: len(own)] == states - 1
        more = ((0, 0), (0, width - chunk), (0, 0))
        to, hits = (np.pad(v.reshape(n, chunk, states), more) for v in (to, hits))
        to[:, chunk:] = np.arange(states)
        while to.shape[1] > 1:
            left = to[:, ::2]
            hits = hits[:, ::2] + np.take_along_axis(hits[:, 1::2], left, 2)
            to = np.take_along_axis(to[:, 1::2], left, 2)
        yield from zip(to[:, 0].tolist(), hits[:, 0].tolist(), strict=True)


def find_signature(seq: str, pattern: str, chunk: int = 512) -> list[int]:
    """Hits by transfer functions: chunks without a hit from their true start state are never looked at again."""
    table, m, x = automaton(pattern), len(pattern), encode(seq)
    rows, state, out = table.tolist(), 0, []
    for lo, (to, hits) in zip(range(0, len(x), chunk), transfers(table, x, chunk), strict=True):
        if hits[state]:
            s = state
            for i, c in enumerate(x[lo : lo + chunk].tolist(), lo - m + 1):
                s = rows[s][c]
                if s == m:
                    out.append(i)
        state = to[state]
    return out


class PhraseSearch:
    """Search on codewords: the effect of every phrase on the automaton is found once, from that of the phrase it extends, and a
    sequence is a walk over its phrase numbers. A phrase is spelled out only where a hit ends inside it."""

    def __init__(self, pattern: str, parent: np.ndarray, symbol: np.ndarray, length: np.ndarray):
        self.table, self.m = automaton(pattern), len(pattern)
        self.parent, self.symbol, self.length = parent, symbol, length.tolist()
        states = len(self.table)
        to, hits = np.zeros((len(parent), states), np.int32), np.zeros((len(parent), states), bool)
        by_length = np.argsort(length, kind="stable")
        cuts = np.searchsorted(length[by_length], np.arange(1, (length.max() if len(length) else 0) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            nodes = by_length[lo:hi]
            up = parent[nodes]
            before = np.where((up >= 0)[:, None], to[up], np.arange(states))
            to[nodes] = self.table[before, symbol[nodes][:, None]]
            hits[nodes] = (to[nodes] == self.m) | ((up >= 0)[:, None] & hits[up])
        self.to, self.hits = to.tolist(), hits.tolist()

    def spelled(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(int(self.symbol[node]))
            node = int(self.parent[node])
        return out[::-1]

    def find(self, codes) -> list[int]:
        """Offsets of all overlapping hits in the sequence with these phrases."""
        state, at, out = 0, 0, []
        for code in codes:
            if self.hits[code][state]:
                s = state
                for i, x in enumerate(self.spelled(code)):
                    s = self.table[s, x]
                    if s == self.m:
                        out.append(at + i - self.m + 1)
            state = self.to[code][state]
            at += self.length[code]
        return out


class PatternSet:
    """One automaton of many patterns: ``to`` gives the next state of a state and letter, ``ends`` the patterns that end in a state."""

    def __init__(self, patterns: list[str]):
        self.lengths = [len(p) for p in patterns]
        self.to, self.ends = [[0] * 5], [[]]
        for k, p in enumerate(patterns):
            state = 0
            for x in encode(p).tolist():
                if not self.to[state][x]:
                    self.to[state][x] = len(self.to)
                    self.to.append([0] * 5)
                    self.ends.append([])
                state = self.to[state][x]
            if not state:
                raise ValueError("empty pattern")
            self.ends[state].append(k)
        # states by depth: where no pattern goes on, the longest suffix that is a state does
        border, level = [0] * len(self.to), [s for s in self.to[0] if s]
        while level:
            below = []
            for s in level:
                self.ends[s] = self.ends[s] + self.ends[border[s]]
                for x in range(5):
                    t = self.to[s][x]
                    if t:
                        border[t] = self.to[border[s]][x]
                        below.append(t)
                    else:
                        self.to[s][x] = self.to[border[s]][x]
            level = below


class PhraseWalk:
    """Many patterns on codewords: what a phrase does to a state of the automaton is worked out when a sequence first meets both, from the
    phrase it extends, and kept. Work and memory follow what is met, not patterns times phrases."""

    def __init__(self, patterns: PatternSet, parent: list[int], symbol: list[int], length: list[int]):
        self.set, self.parent, self.symbol, self.length = patterns, parent, symbol, length
        self.known: dict[tuple[int, int], tuple[int, bool]] = {}

    def effect(self, node: int, state: int) -> tuple[int, bool]:
        """State after the phrase, and whether a pattern ends in it."""
        chain, at = [], node
        while at >= 0 and (at, state) not in self.known:
            chain.append(at)
            at = self.parent[at]
        now, hit = self.known[at, state] if at >= 0 else (state, False)
        for n in reversed(chain):
            now = self.set.to[now][self.symbol[n]]
            hit = hit or bool(self.set.ends[now])
            self.known[n, state] = now, hit
        return now, hit

    def find(self, codes) -> list[tuple[int, int]]:
        """(pattern, offset) of all hits, overlapping ones too, in the sequence with these phrases."""
        state, at, out = 0, 0, []
        for code in codes:
            after, hit = self.effect(code, state)
            if hit:
                letters, node = [], code
                while node >= 0:
                    letters.append(self.symbol[node])
                    node = self.parent[node]
                s = state
                for i, x in enumerate(reversed(letters)):
                    s = self.set.to[s][x]
                    out += [(k, at + i + 1 - self.set.lengths[k]) for k in self.set.ends[s]]
            state = after
            at += self.length[code]
        return out
