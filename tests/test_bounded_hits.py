"""Hits leave tasks in bounded batches, and alignments taken apart in numpy give what plain loops give."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from strandframe.operators import codec, search


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(search, "HITS", 100)
    pieces = [(np.full(30, k), np.arange(30)) for k in range(20)]
    got = list(search.batched(iter(pieces), ["seq", "offset"]))
    assert max(b.num_rows for b in got) <= 130 and len(got) == 5
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(k, o) for k in range(20) for o in range(30)]


def test_loaded_groups_leave_one_by_one(spark):
    rng = random.Random(5)
    rows = [(k // 3, k, s, s) for k, s in enumerate("".join(rng.choices("ACGTN", k=40)) for _ in range(30))]
    a = spark.createDataFrame(rows, "grp long, seq long, ref_aln string, seq_aln string").coalesce(1)
    found = codec.search_groups(codec.load_groups(codec.compress_groups(a), a.selectExpr("grp", "seq", "ref_aln AS ref")), "aa")
    assert sorted(map(tuple, found.collect())) == sorted((k, o) for _, k, s, _ in rows for o in range(39) if s[o : o + 2] == "AA")


def test_runs_and_ends_against_loops(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choices("AC-", (6, 1, 1), k=n)), "".join(rng.choices("AC-", (6, 1, 1), k=n))) for k, n in enumerate([1, 5, 63, 64, 65, 128, 200, 300, 64, 128])]
    rows += [(10, "A" * 64, "A" * 63 + "C"), (11, "A" * 65, "A" * 65)]  # a change in the last place of a word, seen by another alignment
    a = spark.createDataFrame(rows, "seq long, ref_aln string, seq_aln string").withColumn("corpus", F.floor(F.col("seq") / 5))
    want, changed = [], {}
    for seq, r, s in rows:
        ops = ["I" if x == "-" else "D" if y == "-" else "M" if x == y else "X" for x, y in zip(r, s, strict=True) if x + y != "--"]
        for op in sorted(set(ops)):
            want.append((seq, op, ops.count(op), sum(k == op for k, _ in itertools.groupby(ops))))
        for p, op in enumerate(o for o in ops if o != "I"):
            changed[seq // 5, p] = changed.get((seq // 5, p), False) or op != "M"
    assert sorted(map(tuple, codec.op_runs(a).collect())) == sorted(want)
    ends = sorted((c, p) for (c, p), x in changed.items() if not x and changed.get((c, p - 1)))
    assert sorted((r.corpus, r.pos) for r in codec.sync_map(a, ("corpus",)).collect()) == ends
    assert "Window" not in codec.sync_map(a, ("corpus",))._jdf.queryExecution().toString()
