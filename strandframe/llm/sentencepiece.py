"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the pieces.

The vocabulary file is read once on the driver (its path is a parameter); the trie arrays, one entry per
trie node, are bounded by the vocabulary and go to the tasks with the function. The scores of the file are the log scores. The
best path is the one of the largest sum; of equal ones that found first (longest last piece) stays. A
character that no piece covers alone costs the smallest score less 10 and becomes its UTF-8 byte pieces.
Spaces become the marker U+2581, with one more in front; decoding turns markers back and drops it.

A text is cut only where no piece can lie across: before a marker that follows another character, and
around line breaks and tabs if no piece holds them. Words are looked up in a cache per task; it is emptied
when it holds ``CACHE`` words, which changes no result.

Nulls and edges: null text is encoded as the empty one, which has no pieces. A text that itself holds
U+2581 decodes with a space there (``round_trip`` says false). Rows that repeat are encoded each. Empty
table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
CACHE = 400_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(buf: bytes):
    """(field number, value) of a serialized message: ints, 4-byte and 8-byte values raw, or bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        elif kind == 5:
            value, at = buf[at : at + 4], at + 4
        else:
            n = varint()
            value, at = buf[at : at + n], at + n
        yield tag >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """Pieces (text, score, type) of a model file, and whether it puts a marker in front."""
    pieces, prefix = [], True
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)))
        elif number == 3:
            prefix = bool(dict(_fields(value)).get(3, 1))
    return pieces, prefix


class DoubleArray:
    """Trie over bytes in two arrays: child of s by byte c is base[s] + c + 1 where check holds s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        tree: list[dict[int, int]] = [{}]
        ids = [-1]
        for i in order:
            s = 0
            for c in keys[i]:
                if c not in tree[s]:
                    tree[s][c] = len(tree)
                    tree.append({})
                    ids.append(-1)
                s = tree[s][c]
            ids[s] = i
        size = 2 * len(tree) + 1024
        taken = bytearray(size)
        taken[0] = 1
        place, free, hint = {0: 0}, 300, 1
        # nodes of many children first; nodes of one child fill the gaps they leave
        inner = [[], []]
        todo = [0]
        while todo:
            node = todo.pop()
            inner[len(tree[node]) > 1].append(node)
            todo += tree[node].values()
        base_of = {}
        for node in sorted(inner[1], key=lambda x: -len(tree[x])) + inner[0]:
            codes = sorted(c + 1 for c in tree[node])
            if not codes:
                continue
            if len(codes) == 1:
                while taken[free]:
                    free += 1
                    if free + 600 > len(taken):
                        taken.extend(bytes(size))
                b = max(0, free - codes[0])
                while taken[b + codes[0]]:
                    b += 1
            else:
                b, tries = hint, 0
                while any(taken[b + c] for c in codes):
                    b += 1
                    tries += 1
                    if b + 600 > len(taken):
                        taken.extend(bytes(size))
                hint = b if tries > 64 else hint
            base_of[node] = b
            for c in codes:
                taken[b + c] = 1
            if b + 900 > len(taken):
                taken.extend(bytes(size))
        size = len(taken)
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], value[0] = 0, ids[0]
        todo = [0]
        while todo:
            node = todo.pop()
            at = place[node]
            value[at] = ids[node]
            base[at] = base_of.get(node, 0)
            for c, child in tree[node].items():
                place[child] = t = base[at] + c + 1
                check[t] = at
                todo.append(child)
        self.base, self.check, self.value = base, check, value


class Unigram:
    """Encoder and decoder over a list of (piece, score, type)."""

    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool = True):
        self.pieces, self.prefix = pieces, prefix
        normal = [s for _, s, k in pieces if k == NORMAL] or [0.0]
        low, high = min(normal), max(normal)
        self.unk_score = low - 10
        used = [i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER) and p]
        da = DoubleArray([pieces[i][0].encode() for i in used])
        self.base, self.check = da.base, da.check
        self.ids = [used[v] if v >= 0 else -1 for v in da.value]
        self.scores = [s if k != USER else len(p) * high - 0.1 for p, s, k in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unk = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        inside = [pieces[i][0] for i in used]
        across = any(re.search(f"[^{MARK}]{MARK}", p) for p in inside)
        hard = re.escape("".join(c for c in "\n\t\r" if not any(c in p for p in inside)))
        letter = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
        # where no piece joins a letter and another character, words and what stands between them part too
        mixed = any(re.search(rf"{letter}(?!{letter}).|(?!{letter})[^{MARK}]{letter}", p, re.S) for p in inside)
        parts = [f"{MARK}*[^{MARK}{hard}]+"] if mixed else [f"{MARK}*{letter}+", f"(?:{MARK}*)(?:(?!{letter})[^{MARK}{hard}])+"]
        self.cut = None if across else re.compile("|".join(([f"[{hard}]"] if hard else []) + parts + [f"{MARK}+"]))
        self.mixed = mixed
        self.cache: dict[str, list[int]] = {}
        self.text = [MARK if k == NORMAL and p == MARK else p for p, _, k in pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, (_, _, k) in enumerate(pieces) if k == CONTROL}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def viterbi(self, segment: str) -> list[int]:
        raw = segment.encode()
        n = len(raw)
        best, back = [None] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        base, check, ids, scores, size = self.base, self.check, self.ids, self.scores, len(self.check)
        at = 0
        while at < n:
            here, lead = best[at], raw[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single, s, k = False, 0, at
            while k < n:
                t = base[s] + raw[k] + 1
                if t >= size or check[t] != s or t == 0:
                    break
                s, k = t, k + 1
                i = ids[s]
                if i >= 0:
                    new = here + scores[i]
                    if best[k] is None or new > best[k]:
                        best[k], back[k] = new, (at, i)
                    single = single or k - at == width
            if not single:
                k, new = at + width, here + self.unk_score
                if best[k] is None or new > best[k]:
                    best[k], back[k] = new, (at, -1)
            at += width
        out: list[int] = []
        while n:
            start, i = back[n]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(raw[start:n]))
            else:
                out.append(self.unk)
            n = start
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.prefix:
            marked = MARK + marked
        if self.cut is None:
            return self.viterbi(marked)
        out: list[int] = []
        cache = self.cache
        for segment in self.cut.findall(marked):
            got = cache.get(segment)
            if got is None:
                got = self.viterbi(segment)
                if len(segment) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[segment] = got
            out += got
        return out

    def decode(self, ids) -> str:
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            if i not in self.control:
                out.append(self.text[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: Unigram) -> DataFrame:
    """(doc_id, n_pieces, n_bytes, round_trip, piece_ids) for every row of ``docs``."""

    def run(batches):
        own = model
        for b in batches:
            ids, offsets, n_bytes, same = [], [0], [], []
            for text in b.column(1).to_pylist():
                got = own.encode(text)
                ids.append(np.array(got, np.int32))
                offsets.append(offsets[-1] + len(got))
                n_bytes.append(sum(map(own.byte_of.__contains__, got)))
                same.append(own.decode(got) == (text or ""))
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same), lists],
                ["doc_id", "n_pieces", "n_bytes", "round_trip", "piece_ids"],
            )

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, round_trip boolean, piece_ids array<int>")


def decode_documents(encoded: DataFrame, model: Unigram) -> DataFrame:
    """(doc_id, text) from (doc_id, piece_ids); null ids decode to the empty text."""

    def run(batches):
        for b in batches:
            texts = [model.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")
