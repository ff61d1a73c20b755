"""Many patterns on a stored compressed index against plain scans of the texts."""

import random

import pytest

from strandframe.functions.search import PatternSet, PhraseWalk
from strandframe.operators import codec
from strandframe.sources.shared import shared_path


def scan(text, patterns):
    return sorted((k, o) for k, p in enumerate(patterns) for o in range(len(text) - len(p) + 1) if text[o : o + len(p)] == p)


def test_walk_against_scan():
    rng = random.Random(8)
    for _ in range(60):
        patterns = list(dict.fromkeys("".join(rng.choices("ACN", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 6))))
        parent, symbol, length, spelled = [], [], [], []
        for _ in range(30):  # phrases that extend earlier ones
            up = rng.randint(-1, len(parent) - 1)
            x = rng.choice([0, 1, 4])
            parent.append(up)
            symbol.append(x)
            length.append(1 + (length[up] if up >= 0 else 0))
            spelled.append((spelled[up] if up >= 0 else "") + "ACGTN"[x])
        walk = PhraseWalk(PatternSet(patterns), parent, symbol, length)
        for _ in range(4):
            codes = rng.choices(range(30), k=rng.randint(0, 12))
            assert sorted(walk.find(codes)) == scan("".join(spelled[c] for c in codes), patterns)
    with pytest.raises(ValueError):
        PatternSet(["A", ""])


def test_index_is_stored_once(spark):
    rng = random.Random(2)
    rows = []
    for k in range(30):
        ref = "".join(rng.choices("ACGT", k=rng.randint(1, 120)))
        rows.append((k // 7, k, ref, "".join(x if rng.random() < 0.9 else rng.choice("ACGTN-") for x in ref)))
    a = spark.createDataFrame(rows, "grp long, seq long, ref_aln string, seq_aln string")
    index = codec.load_groups(codec.compress_groups(a), a.selectExpr("grp", "seq", "ref_aln AS ref"))
    path = shared_path(spark, "phrases")
    codec.save_index(index, path)
    texts = {k: s.replace("-", "") for _, k, _, s in rows}
    for patterns in (["acg", "A", "TTA", "ACGT", "acg"], ["GN", "CC"], ["ACGTACGTACGTACGT" * 20]):
        shown = sorted({p.upper() for p in patterns})
        want = sorted((shown[i], k, o) for k, t in texts.items() for i, o in scan(t, shown))
        got = codec.search_many(codec.open_index(spark, path), patterns)
        assert sorted((r.pattern, r.seq, r.offset) for r in got.collect()) == want
    assert codec.search_many(codec.open_index(spark, path), []).count() == 0
    assert codec.search_many(codec.open_index(spark, path).limit(0), ["A"]).count() == 0
    chosen = codec.search_many(codec.open_index(spark, path).where("grp = 2"), ["A"])
    assert {r.seq for r in chosen.collect()} <= set(range(14, 21))
