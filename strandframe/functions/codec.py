"""Dictionary codec of aligned sequences: phrases of a growing trie, coded against a reference.

A match column follows the trie; where no child exists the trie grows, but only while the phrase holds matches
alone, so that a decoder that meets an id it does not know can copy the phrase from the reference. Mismatches
follow existing paths only. Insertions are blocks of existing phrases, deletions are run lengths in Elias delta.
Ids 0-4 are ACGTN, then the insertion, deletion and width codes; the width starts at 3 bits. Every sequence
states its number of items first, so insertions after the last reference column are kept.
"""

from __future__ import annotations

import numpy as np

BASES = "ACGTN"
INS, DEL, WIDTH = 5, 6, 7
FIRST = 8
#: Number of each letter in either case, 255 for others.
_NUMBER = np.full(256, 255, np.uint8)
for _k, _x in enumerate(BASES):
    _NUMBER[[ord(_x), ord(_x.lower())]] = _k
_GAP = ord("-")
#: Places of a node's five children: 0 where there is none, as no child has a number under FIRST.
_NONE = (0, 0, 0, 0, 0)


def _gamma(n: int) -> tuple[int, int]:
    if n < 1:
        raise ValueError("codes start at 1")
    return n, 2 * n.bit_length() - 1


def _delta(n: int) -> tuple[int, int]:
    """Number and width of an Elias delta code."""
    value, width = _gamma(n.bit_length())
    rest = n.bit_length() - 1
    return (value << rest) | (n - (1 << rest)), width + rest


#: Codes of small numbers, and (number, width) of the delta code that begins 12 bits, None where it is longer.
_SMALL = [(0, 0), *map(_delta, range(1, 256))]
_BEGUN: list = [None] * 4096
for _n, (_k, _w) in enumerate(_SMALL):
    if 0 < _w <= 12:
        _BEGUN[_k << (12 - _w) : (_k + 1) << (12 - _w)] = [(_n, _w)] * (1 << (12 - _w))


class BitWriter:
    """Numbers of up to 64 bits, held until some thousand are packed together."""

    def __init__(self):
        self.done, self.tail, self.bits = [], (0, 0), 0
        self.values: list[int] = []
        self.widths: list[int] = []

    def put(self, value: int, width: int) -> None:
        self.values.append(value)
        self.widths.append(width)
        self.bits += width
        if len(self.values) >= 4096:
            self._pack()

    def put_all(self, values: list[int], widths: np.ndarray) -> None:
        self._pack()
        self.bits += int(widths.sum())
        for k in range(0, len(values), 1 << 18):
            self._add(np.array(values[k : k + (1 << 18)], np.uint64), widths[k : k + (1 << 18)])

    def gamma(self, n: int) -> None:
        self.put(*_gamma(n))

    def delta(self, n: int) -> None:
        self.put(*_delta(n))

    def _pack(self) -> None:
        if self.values:
            self._add(np.array(self.values, np.uint64), np.array(self.widths, np.int64))
            self.values, self.widths = [], []

    def _add(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Whole bytes to ``done``, the bits that are left to ``tail``."""
        values, widths = np.append(np.uint64(self.tail[0]), values), np.append(self.tail[1], widths)
        ends = np.cumsum(widths)
        down = np.repeat(ends, widths) - 1 - np.arange(ends[-1])
        bits = (np.repeat(values, widths) >> down.astype(np.uint64)).astype(np.uint8) & 1
        cut = len(bits) // 8 * 8
        self.done.append(np.packbits(bits[:cut]).tobytes())
        self.tail = int("0" + "".join(map(str, bits[cut:].tolist())), 2), len(bits) - cut

    def bytes(self) -> bytes:
        self._pack()
        value, size = self.tail
        return b"".join(self.done) + (bytes([value << (8 - size)]) if size else b"")


class BitReader:
    """Numbers from the bits of ``data``: ``window`` holds the 32 bits from each place on, zeros after the end."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint64)
        n = len(data)
        five = sum(raw[k : n + k] << np.uint64(32 - 8 * k) for k in range(5))
        window = np.empty((n + 1, 8), np.uint32)
        for k in range(8):
            window[:n, k] = (five >> np.uint64(8 - k)) & np.uint64(0xFFFFFFFF)
        window[n] = 0
        self.window, self.at, self.end = memoryview(window.ravel()), 0, 8 * n

    def get(self, width: int) -> int:
        at, self.at, value = self.at, self.at + width, 0
        if self.at > self.end:
            raise EOFError("the stream ends early")
        while width > 32:
            value, at, width = (value << 32) | self.window[at], at + 32, width - 32
        return (value << width) | (self.window[at] >> (32 - width)) if width else value

    def gamma(self) -> int:
        zeros = 0
        while not self.get(1):
            zeros += 1
        return (1 << zeros) | self.get(zeros)

    def delta(self) -> int:
        n = self.gamma() - 1
        return (1 << n) | self.get(n)


class Trie:
    """Phrases by number: ``kids`` has five places a node, parent, symbol and length are those of a node. ``head`` is the first of the nodes
    before it that each extend the one before, so that a phrase is a few slices of ``symbol``."""

    def __init__(self):
        self.kids = [0] * (5 * FIRST)
        self.parent = [-1] * FIRST
        self.symbol = [*range(5), -1, -1, -1]
        self.length = [1] * 5 + [0] * 3
        self.head = list(range(FIRST))
        self.letters = bytearray(b"ACGTN---")
        self.known: dict[int, str] = {}

    def grow(self, node: int, symbol: int) -> int:
        new = len(self.parent)
        self.kids[5 * node + symbol] = new
        self.kids += _NONE
        self.parent.append(node)
        self.symbol.append(symbol)
        self.length.append(self.length[node] + 1)
        self.head.append(self.head[node] if node == new - 1 and node >= FIRST else new)
        self.letters.append(self.letters[symbol])
        return new

    def spelled(self, node: int) -> str:
        """Letters of a phrase; short ones are kept."""
        got = self.known.get(node)
        if got is None:
            parts, at = [], node
            while at >= 0:
                head = self.head[at]
                parts.append(self.letters[head : at + 1])
                at = self.parent[head]
            got = b"".join(reversed(parts)).decode("ascii")
            if len(got) <= 32:
                self.known[node] = got
        return got


def _symbols(text: str) -> list[int]:
    out = _NUMBER[np.frombuffer(text.upper().encode("latin-1", "replace"), np.uint8)]
    if (out > 4).any():
        raise ValueError("a sequence may hold A, C, G, T and N only")
    return out.tolist()


#: Operations of columns: match, mismatch, insertion, deletion.
_M, _X, _I, _D = range(4)


def columns(ref_aln: str, seq_aln: str) -> tuple[np.ndarray, np.ndarray]:
    """(operation, number of the letter) of each column: the sequence's letter, the reference's in a deletion; columns of two gaps vanish."""
    if len(ref_aln) != len(seq_aln):
        raise ValueError("the rows of an alignment differ in length")
    r, s = (np.frombuffer(x.upper().encode("latin-1", "replace"), np.uint8) for x in (ref_aln, seq_aln))
    both = (r != _GAP) | (s != _GAP)
    r, s = r[both], s[both]
    op = np.where(r == _GAP, _I, np.where(s == _GAP, _D, np.where(r == s, _M, _X)))
    base = _NUMBER[np.where(op == _D, r, s)]
    if (base > 4).any():
        raise ValueError("a sequence may hold A, C, G, T and N only")
    return op, base


class Encoder:
    """Encodes aligned sequences of one group; the trie is shared, in order of arrival."""

    def __init__(self, sync: int = 0, points: list[int] | None = None):
        self.kids, self.size, self.width, self.out = [0] * (5 * FIRST), FIRST, 3, BitWriter()
        self.sync, self.points = sync, np.array(sorted(points or ()), np.int64)

    def add(self, ref_aln: str, seq_aln: str) -> dict:
        """Append one sequence; returns its counts and bits."""
        op, base = columns(ref_aln, seq_aln)
        own = op != _I
        at = np.cumsum(own) - own
        ended = own & np.isin(at, self.points)
        if self.sync:
            ended |= own & (at > 0) & (at % self.sync == 0)
        kind = np.where(op == _X, _M, op)
        starts = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | ended)
        letters = np.where(op == _X, base + 8, base).astype(np.uint8).tobytes()  # a mismatch from 8 on
        kids, size, width = self.kids, self.size, self.width
        values: list[int] = []
        items, odd, spans = 0, [], [(0, width)]  # numbers that are no codes as (place, width); width of codes from a place on

        for lo, hi, k in zip(starts.tolist(), [*starts[1:].tolist(), len(op)], kind[starts].tolist(), strict=False):
            if k == _M:
                node, dirty, fresh = -1, False, False
                for x in letters[lo:hi]:
                    if x < 8:
                        nxt = kids[5 * node + x] if node >= 0 else x
                        if nxt or node < 0:
                            node = nxt
                        elif dirty:
                            values.append(node)
                            items += 1
                            node, dirty, fresh = x, False, False
                        elif size == 1 << width:
                            values += (node, WIDTH)
                            items += 2
                            width += 1
                            spans.append((len(values), width))
                            node, fresh = x, False
                        else:
                            kids[5 * node + x] = node = size
                            kids += _NONE
                            size += 1
                            fresh = True
                    else:
                        nxt = kids[5 * node + x - 8] if node >= 0 else x - 8
                        if node >= 0 and (fresh or not nxt):
                            values.append(node)
                            items += 1
                            nxt, fresh = x - 8, False
                        node, dirty = nxt, True
                values.append(node)
            elif k == _D:
                n = hi - lo
                value, bits = _SMALL[n] if n < 256 else _delta(n)
                odd.append((len(values) + 1, bits))
                values += (DEL, value)
            else:
                node, found = -1, []
                for x in letters[lo:hi]:
                    nxt = kids[5 * node + x] if node >= 0 else x
                    if node >= 0 and not nxt:
                        found.append(node)
                        nxt = x
                    node = nxt
                found.append(node)
                n = len(found)
                value, bits = _SMALL[n] if n < 256 else _delta(n)
                odd.append((len(values) + 1, bits))
                values += (INS, value)
                values += found
            items += 1
        before = self.out.bits
        self.out.delta(items + 1)
        places, own_width = zip(*spans, strict=True)
        widths = np.repeat(own_width, np.diff([*places, len(values)]))
        if odd:
            places, bits = zip(*odd, strict=True)
            widths[list(places)] = bits
        self.out.put_all(values, widths)
        self.size, self.width = size, width
        counts, runs = np.bincount(op, minlength=4).tolist(), np.bincount(op[np.flatnonzero(np.diff(op, prepend=-1))], minlength=4).tolist()
        stats = dict(zip(("matches", "replaces", "insertions", "deletions", "match_runs", "replace_runs", "insert_runs", "delete_runs"), counts + runs, strict=True))
        return stats | {"items": items, "bits": self.out.bits - before}


class Decoder:
    def __init__(self, data: bytes):
        self.trie, self.width, self.data = Trie(), 3, BitReader(data)

    def phrases(self, ref: str) -> list[int]:
        """The phrases of the next sequence, in order; ``ref`` is its ungapped reference."""
        trie, data, r, at, out = self.trie, self.data, _symbols(ref), 0, []
        kids, length, window, end = trie.kids, trie.length, data.window, data.end
        left, width, size = data.delta() - 1, self.width, len(trie.parent)
        place = data.at
        while left:
            left -= 1
            code = window[place] >> (32 - width) if place < end else 0
            place += width
            if place > end:
                raise EOFError("the stream ends early")
            if code >= size:
                if at >= len(r):
                    raise ValueError("a phrase runs past the reference")
                node, at = r[at], at + 1
                while node != code:
                    if at >= len(r):
                        raise ValueError("a phrase runs past the reference")
                    x, at = r[at], at + 1
                    nxt = kids[5 * node + x]
                    if not nxt:
                        nxt, size = trie.grow(node, x), size + 1
                    node = nxt
                    if node > code:
                        raise ValueError("unknown code")
                out.append(code)
            elif code < 5 or code > WIDTH:
                out.append(code)
                at += length[code]
            elif code == WIDTH:
                width += 1
            else:
                begun = _BEGUN[window[place] >> 20] if place < end else None
                if begun:
                    n, bits = begun
                    place += bits
                else:
                    data.at = place
                    n, place = data.delta(), data.at
                if code == DEL:
                    at += n
                elif place + n * width <= end:
                    out += [window[k] >> (32 - width) for k in range(place, place + n * width, width)]
                    place += n * width
                else:
                    raise EOFError("the stream ends early")
        data.at, self.width = place, width
        return out

    def next(self, ref: str) -> str:
        """The next sequence, ungapped."""
        return "".join(map(self.trie.spelled, self.phrases(ref)))


def compress(rows: list[tuple[str, str, str]], sync: int = 0, points: list[int] | None = None) -> tuple[bytes, list[dict]]:
    """Container of (name, ref_aln, seq_aln) rows: 32-bit count, NUL-terminated names, code stream."""
    enc = Encoder(sync, points)
    stats = [enc.add(r, s) for _, r, s in rows]
    head = len(rows).to_bytes(4, "big") + b"".join(n.encode() + b"\0" for n, _, _ in rows)
    return head + enc.out.bytes(), stats


def _head(data: bytes) -> tuple[list[str], bytes]:
    """Names of a container, and its code stream."""
    n, at, names = int.from_bytes(data[:4], "big"), 4, []
    for _ in range(n):
        end = data.index(b"\0", at)
        names.append(data[at:end].decode())
        at = end + 1
    return names, data[at:]


def decompress(data: bytes, refs: list[str]) -> list[tuple[str, str]]:
    """(name, sequence) of a container; ``refs`` holds the ungapped reference of each sequence."""
    names, codes = _head(data)
    dec = Decoder(codes)
    return [(name, dec.next(ref)) for name, ref in zip(names, refs, strict=True)]


def load(data: bytes, refs: list[str]) -> tuple[list[str], Trie, list[list[int]]]:
    """Names, phrases and the phrase numbers of each sequence: all that a search needs, without references or bits."""
    names, codes = _head(data)
    dec = Decoder(codes)
    found = [dec.phrases(ref) for ref in refs]
    if len(found) != len(names):
        raise ValueError("a container holds another number of sequences")
    return names, dec.trie, found
