"""Viterbi against brute force and against the library on a model whose scores fit its floats; exact round trips."""

import random

import pytest

from strandframe.llm import sentencepiece as S

PIECES = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL)] + [(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)]
PIECES += [(p, -float(s), S.NORMAL) for p, s in [("▁", 3), ("a", 4), ("b", 4.5), ("ab", 5), ("▁a", 4.25), ("▁ab", 6), ("aba", 7.5), ("ba", 6.25), ("é", 8), ("bé", 9.5), (",", 5), ("▁▁", 4)]]


def best_score(pieces, text):
    scores = {p: s for p, s, k in pieces if k == S.NORMAL}
    low = min(scores.values()) - 10
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            p = text[start:end]
            s = scores.get(p, low if len(p) == 1 else None)
            if s is not None and (best[end] is None or best[start] + s > best[end]):
                best[end] = best[start] + s
    return best[-1]


def score(model, ids, pieces):
    low = min(s for _, s, k in pieces if k == S.NORMAL) - 10
    total, pending = 0.0, bytearray()
    for i in [*ids, None]:
        if i is not None and i in model.byte_of:
            pending.append(model.byte_of[i])
            continue
        total += low * len(pending.decode())
        pending = bytearray()
        total += model.scores[i] if i is not None else 0
    return total


def test_viterbi_is_optimal():
    rng, model = random.Random(1), S.Unigram(PIECES)
    for _ in range(400):
        text = "".join(rng.choice("ab é,z\n漢") for _ in range(rng.randint(1, 18)))
        ids = model.encode(text)
        assert score(model, ids, PIECES) == pytest.approx(best_score(PIECES, "▁" + text.replace(" ", "▁")))
        assert model.decode(ids) == text


def test_trie_holds_all_keys():
    rng = random.Random(2)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randint(1, 6))) for _ in range(3000)})
    t = S.DoubleArray(keys)

    def find(key):
        s = 0
        for c in key:
            n = t.base[s] + c + 1
            if n >= len(t.check) or t.check[n] != s or not n:
                return -1
            s = n
        return t.value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"\0\1\2") == -1 for k in keys if k + b"\0\1\2" not in keys)


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_against_library(path):
    lib = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.score < -1e6:  # beyond the exact integers of the library's floats
            p.score = -40_000.0
    ref = lib.SentencePieceProcessor(model_proto=proto.SerializeToString())
    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    model, rng = S.Unigram(pieces), random.Random(6)
    words = "The of and thonre edly, tion. Über größe años niño çà être 12 3.5 (a) x-ray".split()
    for _ in range(300):
        text = " ".join(rng.choice(words) + rng.choice(words) * rng.randint(0, 1) for _ in range(rng.randint(1, 12)))
        assert model.encode(text) == ref.encode(text)


def test_segments_do_not_change_results(path):
    pieces, prefix = S.read_model(path)
    model, whole = S.Unigram(pieces, prefix), S.Unigram(pieces, prefix)
    whole.cut = None
    for text in ["", " ", "  a  b ", "Hello, world!\n\tNext line (x).", "naïve ² x² Ωmega", "漢字\r\n", "a" * 3000, "\0é𝄞"]:
        assert model.encode(text) == whole.encode(text) and model.decode(model.encode(text)) == text


def test_documents(spark, path):
    model = S.Unigram(*S.read_model(path))
    rows = [(1, "Some text."), (2, None), (3, ""), (1, "Some text."), (None, "x▁y"), (4, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece_ids")
    got = S.encode_documents(df, model)
    assert [(r["doc_id"], r["n_pieces"], r["piece_ids"], r["round_trip"]) for r in got.collect()] == [(d, len(model.encode(t)), model.encode(t), "▁" not in (t or "")) for d, t in rows]
    back = {r["doc_id"]: r["text"] for r in S.decode_documents(got, model).collect()}
    assert back[4] == rows[5][1] and back[2] == back[3] == "" and back[None] == "x y"
    assert S.encode_documents(df.where("false"), model).count() == 0
