"""Contrast of two groups against all genotypes, intervals and priors; shuffled groups against all groups."""

import itertools
import math
import random

import numpy as np
import pytest

from strandframe.functions import stats as K
from strandframe.operators import sites, variants


@pytest.mark.parametrize("n,first,prior", [(3, 1, "full"), (4, 2, "flat"), (4, 3, [0.5, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])])
def test_contrast_by_all_genotypes(spark, n, first, prior, tmp_path):
    rng = random.Random(n)
    pl = [[[0 if g == best else rng.randint(1, 60) for g in range(3)] for best in rng.choices(range(3), k=n)] for _ in range(6)]
    if not isinstance(prior, str):
        (tmp_path / "prior.txt").write_text("\n".join(map(str, prior)) + "\n")
        prior = variants.read_prior(spark, str(tmp_path / "prior.txt"))
    p0 = K._count_prior(n, 1e-3, prior)
    got = variants.group_contrast(spark.createDataFrame(list(enumerate(pl)), "site long, pl array<array<int>>"), first, prior=prior).collect()
    for r in got:
        sums = [0.0, 0.0, 0.0]
        for g in itertools.product(range(3), repeat=n):
            w = p0[sum(g)] * math.prod(math.comb(2, x) * 10 ** (-pl[r["site"]][s][x] / 10) for s, x in enumerate(g)) / math.comb(2 * n, sum(g))
            a, b = sum(g[:first]) * (n - first), sum(g[first:]) * first
            sums[(a > b) - (a < b) + 1] += w
        assert [r["less"], r["equal"], r["more"]] == pytest.approx([x / sum(sums) for x in sums], rel=1e-9)


def test_interval_and_bad_prior():
    post = np.array([[0.02, 0.01, 0.9, 0.05, 0.02], [1.0, 0, 0, 0, 0]])
    low, high = K.count_interval(post)
    assert low.tolist() == [1, 0] and high.tolist() == [3, 0]
    with pytest.raises(ValueError):
        K.count_posteriors(np.zeros((1, 2, 3), int), prior=[1.0, 2.0])


def test_association_by_one_site_and_by_all_groups(spark):
    rng = random.Random(8)
    n, first = 7, 3
    pl = [[[0 if g == best else rng.randint(3, 60) for g in range(3)] for best in ([2] * first + [0] * (n - first) if k == 0 else rng.choices(range(3), k=n))] for k in range(12)]
    df = spark.createDataFrame(list(enumerate(pl)), "site long, pl array<array<int>>")
    group = np.arange(n) < first
    got = {r["site"]: r for r in sites.association(df, first, rounds=700, enough=10**9).collect()}
    for k, own in enumerate(pl):
        m = np.array(own)
        p1, p2 = K.group_lrt(m, group)
        assert (got[k]["p1"], got[k]["p2"]) == pytest.approx((p1, p2), abs=1e-6)
        every = [K.group_lrt(m, np.isin(np.arange(n), c))[0] <= p1 + 1e-9 for c in itertools.combinations(range(n), first)]
        assert got[k]["perm"] == pytest.approx(sum(every) / len(every), abs=0.08)
    few = {r["site"]: r["perm"] for r in sites.association(df, first, rounds=700, enough=10).collect()}
    assert all(few[k] == pytest.approx(got[k]["perm"], abs=0.35) for k in few) and few[0] == pytest.approx(got[0]["perm"], abs=0.05)
    assert [r["perm"] for r in sites.association(df, n).collect()] == [1.0] * 12
