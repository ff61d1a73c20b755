"""The coder's bits stay what they were, and texts are folded once, where they meet."""

import hashlib
import random

import pytest
from strandframe.functions import codec
from strandframe.plans import projections as P


def _rows(seed, n=6, length=900):
    rng = random.Random(seed)
    for k in range(n):
        cols = [rng.choice([("A", "A"), ("C", "C"), ("G", "T"), ("N", "A"), ("-", "G"), ("-", "-"), ("T", "-"), ("ACGT"[k % 4], "ACGT"[k % 4])]) for _ in range(length)]
        yield f"s{k}", "".join(r for r, _ in cols), "".join(s for _, s in cols)


@pytest.mark.parametrize("sync, points, want", [(0, None, "99851224dd8a986c"), (200, None, "9d185fd4463bbd83"), (7, [3, 50], "06b8bb6474a1327c")])
def test_bits_and_counts(sync, points, want):
    rows = list(_rows(sync))
    data, stats = codec.compress(rows, sync, points)
    assert hashlib.sha256(data + repr(stats).encode()).hexdigest()[:16] == want
    assert codec.decompress(data, [r.replace("-", "") for _, r, _ in rows]) == [(n, s.replace("-", "")) for n, _, s in rows]


def test_short_streams_are_errors():
    rows = list(_rows(3, 2))
    data, _ = codec.compress(rows)
    for cut in (1, 40, 300):
        with pytest.raises((EOFError, ValueError)):
            codec.decompress(data[:-cut], [r.replace("-", "") for _, r, _ in rows])


def test_long_phrases_are_spelled_by_slices():
    base = "".join(random.Random(1).choices("ACGT", k=30_000))
    data, _ = codec.compress([("a", base, base), ("b", base, base)])
    names, trie, codes = codec.load(data, [base, base])
    assert "".join(map(trie.spelled, codes[1])) == base and all(len(v) <= 32 for v in trie.known.values())


def test_alignments_fold_texts_as_sequences_do(spark, tmp_path):
    texts = ["Hello, World", "", "naïve café 𝒳y", None, "abc", "ACGT acgt\nN", "x" * 300, "ß-ſ ı"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seqs = {r["seq"]: r["seqs"] for r in P.sequences(spark, str(tmp_path)).collect()}
    got = {r["seq"]: (r["ref_aln"], r["seq_aln"]) for r in P.alignments(spark, str(tmp_path)).collect()}
    want = {}
    for k in range(len(texts) - 1):
        a, b = seqs[k], seqs[k + 1]
        if a and b:
            cols = list(zip(a.ljust(len(b), "-"), b.ljust(len(a), "-"), strict=True))
            want[k] = tuple("".join("-" if x == "N" and y in "ACGT" else x for x, y in (c if side == 0 else c[::-1] for c in cols)) for side in (0, 1))
    assert got == want


def test_alignments_leave_expressions_to_the_kernel(spark):
    plan = P.alignments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "rpad" not in plan
