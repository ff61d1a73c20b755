"""Phrases, importance resampling and chat text against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import chat_format, collocations, importance

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["new", "york", "New", "city", "le", "chat", "é", "x\x01", "x", "zz"]


def docs_of(spark, rows, extra=False):
    """(doc_id, text, lang) rows; with ``extra``, columns named like the operators' own."""
    if extra:
        clash = "block long, codes binary, word string, key string, a long, bucket int, rank string, `n_features` string, `x.y` int, tags map<string,int>"
        return spark.createDataFrame([(d, t, g, "s", 0, 1, b"", "w", "k", 2, 3, "r", "n", 4, {"a": 1}) for d, t, g in rows], f"{DOCS}, {clash}")
    return spark.createDataFrame([(d, t, g, "s", 0) for d, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " ;"]) for _ in range(n))
    rows = [(k, line(rng.randint(0, 80)), rng.choice(["en", "fr", None])) for k in range(90)]
    rows += [(200, None, "en"), (201, "", None), (202, " .,\n\t", "xx"), (203, "once only here", "en"), (None, rows[3][1], rows[3][2])]
    rows += [(300 + k, "same old story. same old story", "en") for k in range(12)] * 2 + [(900, ("ab ba " * 60_000).strip(), "de"), (901, "tie one; tie two; " * 10, "yy")]
    return rows


def lower(text):
    return (text or "").translate(str.maketrans(importance.UPPER, importance.LOWER))


# --- 11


def brute_phrases(rows, min_count=10, max_words=3, inside=50, top=2000):
    f, total = {}, Counter()
    for _, text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang or "und"] += len(ws)
            c.update(tuple(ws[i : i + m]) for m in range(1, max_words + 1) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        found = [p for p, a in c.items() if len(p) > 1 and a >= min_count]
        kept = []
        for p in found:
            a = c[p]
            if any(len(q) > len(p) and 100 * c[q] >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in found):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top,words,extra", [(2000, 3, False), (3, 3, True), (2000, 4, False), (2000, 2, False)])
def test_collocations(spark, texts, top, words, extra):
    got = collocations.collocations(docs_of(spark, texts, extra), top=top, max_words=words)
    assert sorted(map(tuple, got.collect())) == brute_phrases(texts, max_words=words, top=top)


def test_collocations_over_blocks_and_sorts(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 300)
    monkeypatch.setattr(collocations, "SORTED", 50)
    monkeypatch.setattr(collocations, "SLICE", 100)
    monkeypatch.setattr(collocations, "SAMPLED", 5)
    assert sorted(map(tuple, collocations.collocations(docs_of(spark, texts).repartition(7)).collect())) == brute_phrases(texts)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, ",", "en")])).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs_of(spark, []), max_words=1)


def test_score_beyond_64_bits(spark):
    from strandframe.llm.common import Scratch

    n = 3_000_000_000_000
    words = spark.createDataFrame([("en", "p", n + 1, 0), ("en", "q", n + 2, 1)], "lang string, word string, a long, id long")
    found = spark.createDataFrame([(bytearray(b"\0\0\0\0\0\0\0\1"), n)], "key binary, a long")
    row = collocations.scored(found, words, Scratch(spark, "big"), 2).first()
    assert (row["phrase"], row["score"]) == ("p q", 1_000_000 * n * n // ((n + 1) * (n + 2)))


def test_radix_runs():
    ids = np.array([5, 70_000, -1, 5, 70_000, 5, 2**32 - 2, -1, 5])
    digits = collocations.packed(ids, 2)
    keys, counts = collocations.runs(digits)
    pair = lambda a, b: a.to_bytes(4, "big") + b.to_bytes(4, "big")
    keys = [k.astype(">u2").tobytes() for k in keys]
    assert dict(zip(keys, counts.tolist(), strict=True)) == {pair(5, 70_000): 2, pair(70_000, 5): 1, pair(5, 2**32 - 2): 1}
    assert keys == sorted(keys)
    again = collocations.runs(np.concatenate([digits, digits]), np.arange(2 * len(digits)))[1]
    assert again.sum() == sum(range(2 * len(digits))) and len(again) == 3
    assert len(collocations.packed(np.array([3]), 2)) == 0


# --- 12


def brute_resample(rows, target, ngrams=(1, 1), buckets=10_000, min_words=20, percent=10):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(ws) - n + 1)]

    per = [(d, *features(t)) for d, t, _ in rows]
    s, t = Counter(b for _, _, bs in per for b in bs), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(buckets)]
    out = []
    for d, n_words, bs in per:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


TARGET = [(1, "New york new YORK city 42"), (2, None), (3, "")]


@pytest.mark.parametrize("ngrams,buckets,percent,extra", [((1, 1), 10_000, 10, True), ((1, 3), 97, 60, False), ((2, 2), 500, 100, False)])
def test_resample(spark, texts, ngrams, buckets, percent, extra, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 2000)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(docs_of(spark, texts, extra).repartition(5), target, ngrams, buckets, percent=percent)
    assert Counter(map(tuple, got.collect())) == brute_resample(texts, [t for _, t in TARGET], ngrams, buckets, percent=percent)


def test_resample_of_nothing(spark, texts):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert importance.resample(docs_of(spark, []), target).count() == 0
    got = importance.resample(docs_of(spark, texts), target.where("false")).collect()
    assert Counter(map(tuple, got)) == brute_resample(texts, [])


def test_one_document_in_many_copies_is_ranked_whole(spark):
    rows = [(7, "word " * 25, "en")] * 600 + [(8, "other " * 25, "en")] * 5
    got = importance.resample(docs_of(spark, rows), spark.createDataFrame(TARGET, "item_id long, text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 303))


# --- 13

TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss)))
    return Counter(out)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["\\", "<", "</turn>\n", "<turn assistant>\n", "<image 1>", "ok", "é🙂", "\n", ">", "\0", "### Assistant:", "<d", "\\<", "\r\n"]
    rows = [(c, k, rng.choice(["user", "assistant", "system", "a>b\\<", None, ""]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(40) for k in range(rng.randint(1, 6))]
    rows += [(1, 0, "user", "tie"), (1, 0, "assistant", "tie"), (1, 0, "user", "tie"), (2, None, "assistant", None), (None, 3, "assistant", "null id"), (99, 0, "assistant", "<t" * 40_000 + "<")]
    got = chat_format.round_trip(spark.createDataFrame(rows, TURNS).repartition(6)).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_chat(rows)


def test_chat_text_of_a_conversation_parses(spark):
    rows = [(1, 0, "user", "say </turn>\n<turn assistant>\nno"), (1, 1, "assistant", r"\<image 1> and a \ ")]
    got = chat_format.format_turns(spark.createDataFrame(rows, TURNS)).orderBy("place").collect()
    assert list(chat_format.parse("".join(r["formatted"] for r in got))) == [(r, t) for _, _, r, t in rows]
    with pytest.raises(ValueError):
        list(chat_format.parse("<turn user>\nno end"))


def test_chat_parts(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    parts = [part("text", "look <"), part("image", uri="s3://a", w=56, h=57), part("text", "turn x>"), part("audio", uri="b", s=2.5), part("document", uri="c", p=3), part("image"), part("odd", "kept"), part(None)]
    rows = [(1, 0, "user", parts, "unused", 5), (1, 1, "assistant", [part("text", "seen"), part("image", uri="d", w=1, h=1), part("text", " twice")], "", 5), (1, 2, "user", None, "", 5), (1, 3, "user", [], "", 5)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, text string, place int")
    got = chat_format.format_turns(df).orderBy("place").collect()
    assert got[0]["formatted"] == "<turn user>\nlook \\<<image 2>turn x><audio 4><document 5><image 6>kept</turn>\n"
    assert [tuple(a) for a in got[0]["attachments"]] == [(2, "image", "s3://a", 6), (4, "audio", "b", 63), (5, "document", "c", 1536), (6, "image", None, 1)]
    assert got[0]["tokens"] == 2 + 6 + 2 + 63 + 1536 + 1 + 1
    assert [r["formatted"] for r in got[2:]] == ["<turn user>\n</turn>\n"] * 2
    digest = chat_format.read_back(chat_format.format_turns(df)).first()
    assert (digest["n_turns"], digest["loss_chars"], digest["loss_sha256"]) == (4, 10, hashlib.sha256(b"seen twice").hexdigest())


def test_chat_of_nothing(spark):
    assert chat_format.round_trip(spark.createDataFrame([], TURNS)).count() == 0
