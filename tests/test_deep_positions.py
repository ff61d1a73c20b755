"""Positions deeper than any array of rows should be: a task holds the numbers of one position, no list of structs of many."""

import numpy as np
from strandframe.functions import stats as K
from strandframe.operators import calling, depth
from strandframe.plans import queries as q

SF = "/root/testdata/sf0.001"


def _deep(spark, n):
    rows = [(0, 5, f"s{k % 2}", "A", "ACGTN"[k * k % 5], k * 7 % 41, (k * 11) % 256, 16 * (k % 3 == 0), (k * 7919) % n // 2, k % 9 == 0, k % 11 == 0) for k in range(n)]
    return rows, spark.createDataFrame(rows, "tid int, p int, sample string, ref string, base string, baseq int, mapq int, flag int, ord long, is_head boolean, is_tail boolean")


def test_no_lists_of_rows(spark):
    for name in ("site_likelihoods", "mpileup_text"):
        plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan


def test_deep_site(spark):
    rows, pile = _deep(spark, 3000)
    got = calling.site_likelihoods(pile).collect()[0]
    kept = sorted((r[2], "ACGTN".index(r[4]), r[5], r[6], int(r[7] & 16 != 0)) for r in rows)
    best = lambda b, m: min(max(min(b, min(20 if m == 255 else m, 60)), 4), 63)
    total = [sum(best(x[2], x[3]) for x in kept if x[1] == b) for b in range(4)]
    alleles = [0, *sorted((b for b in (1, 2, 3) if total[b]), key=lambda b: -total[b])]
    assert [*got["alts"]] == ["ACGT"[b] for b in alleles[1:]] + (["X"] if len(alleles) < 4 else [])
    alleles += [] if len(alleles) == 4 else [next(b for b in range(5) if b not in alleles)]
    for k, name in enumerate(("s0", "s1")):
        own = [(x[1], best(x[2], x[3]), x[4]) for x in kept if x[0] == name]
        lk = K.pile_costs(own, seed=5)
        pl = np.array([lk[alleles[a], alleles[b]] for b in range(len(alleles)) for a in range(b + 1)])
        assert got["dp"][k] == len(own) == 1500 and got["pl"][k] == np.minimum(np.rint(pl - pl.min()), 255).astype(int).tolist()


def test_deep_text(spark):
    rows, pile = _deep(spark, 3000)  # each ord twice: ties go by what is shown
    got = depth.text(pile).collect()[0]
    shown = sorted((r[8], ("^" + chr((r[6] + 33) % 256) if r[9] else "") + (r[4].lower() if r[7] & 16 else r[4]) + ("$" if r[10] else ""), chr(r[5] + 33)) for r in rows if r[5] >= 13)
    assert got["n"] == len(shown) and got["bases"] == "".join(x[1] for x in shown) and got["quals"] == "".join(x[2] for x in shown)
