"""Consensus: a task gives only the bases that may win, and the winners are those of the fold in arrival order."""

import random

from strandframe.operators import consensus


def test_candidates_win_as_the_fold(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        a, n = rng.randint(1, 6), rng.choice("ID")
        cigar = [(2, "S"), (a, "M"), (2, n), (5, "M")] if k % 3 else [(a, "M"), (3, "N"), (4, "X")]
        rows.append((rng.getrandbits(60), 0, rng.choice(["c", "d"]), rng.randint(-3, 12), rng.choice([0, 30, 30, 60, 255]), cigar, "".join(rng.choice("ACGTacgtR") for _ in range(18))))
    df = spark.createDataFrame(rows, "ord long, flag int, rname string, pos int, mapq int, cigar array<struct<len int, op string>>, seq string").repartition(3)
    m, _ = consensus.bases_and_insertions(df)
    want = {}
    for o, _, name, pos, mapq, cigar, seq in sorted(rows):
        p, q = pos, 0
        for n, op in cigar:
            for k in range(n if op in "MDX" else 0):
                c = "-" if op == "D" else seq[q + k].upper()
                old = want.get((name, p + k))
                if old is None or (mapq != 255 and mapq > old[1]):
                    want[name, p + k] = (c if c in "ACGT-" else "N", mapq)
            p, q = p + n * (op in "MDNX"), q + n * (op in "MISX")
    got = {(r["rname"], r["pos"]): (r["base"], r["mapq"]) for r in consensus.winner(m, ("rname", "pos")).collect()}
    assert {k: v for k, v in got.items() if v[1] != 255} == {k: v for k, v in want.items() if v[1] != 255} and got == want
    assert m.count() <= 2 * 3 * len(want)  # of 600 reads with some 5,500 bases
