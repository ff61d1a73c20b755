"""Rank sums against all orders of letters, distances against loops."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from strandframe.operators import position_bias as B


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (4, 2), (5, 5)])
def test_distribution_is_that_of_all_orders(n, m):
    """n letters of one kind among n + m places: the sum of letters of the other kind before each."""
    counts = Counter()
    for own in combinations(range(n + m), n):
        counts[sum(p - i for i, p in enumerate(own))] += 1
    total = math.comb(n + m, n)
    assert B.rank_sum_distribution(n, m) == pytest.approx([counts[u] / total for u in range(n * m + 1)])
    for u in range(n * m + 1):
        z = B.exact_z(m, n, u)
        assert z == pytest.approx(-B.exact_z(m, n, n * m - u)) or 2 * u == n * m
        if z:
            sd = math.sqrt(n * m * (n + m + 1) / 12)
            assert math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi)) == pytest.approx(counts[u] / total)


def test_sites(spark):
    rng = random.Random(6)
    rows = [(0, s, rng.randrange(n := rng.choice([30, 75])), n, rng.choice("AAG" if s % 2 else "AGG")) for s in range(30) for _ in range(rng.choice([1, 3, 6, 14, 60]))]
    rows += [(0, 99, 5, 30, "G"), (0, 98, 5, 30, "A")]
    pile = spark.createDataFrame([(*r, "A") for r in rows], "tid int, pos int, qpos int, len int, base string, ref string")
    got = {r["pos"]: r for r in B.position_bias(B.place_sums(B.place_counts(pile))).collect()}
    for s in {r[1] for r in rows}:
        place = [(math.floor((q + 1) / (n + 1) * 100), b) for _, p, q, n, b in rows if p == s]
        ref, alt = [p for p, b in place if b == "A"], [p for p, b in place if b != "A"]
        r = got[s]
        assert (r["n_ref"], r["n_alt"]) == (len(ref), len(alt))
        u = sum(x <= y for x in ref for y in alt)
        if not ref or not alt:
            assert r["rank_z"] is None
        elif len(ref) < 8 and len(alt) < 8:
            assert r["rank_z"] == pytest.approx(B.exact_z(len(ref), len(alt), u))
        else:
            assert r["rank_z"] == pytest.approx((u - (len(ref) * len(alt) + 1) / 2) / math.sqrt(len(ref) * len(alt) * (len(ref) + len(alt) + 1) / 12))
        near = np.array([p if p < 50 else 100 - p for p in alt], float)
        if len(near) < 2:
            assert r["distance_bias"] == -1
        else:
            away = np.abs(near - near.mean()).mean()
            assert r["distance_bias"] == pytest.approx(B.distance_chance(np.array([away]), np.array([len(near)]))[0])
    two = B.distance_chance(np.array([0.0, 1.0]), np.array([2, 2]))
    assert two == pytest.approx([(200 + 396) / 10_000, 8 * 96 / 10_000])
    # the curve over distances has area 1
    x = np.arange(-60, 90, 0.01)
    for n in (3, 10, 23, 24, 80):
        assert B.distance_chance(x, np.full(len(x), n)).sum() * 0.01 == pytest.approx(1, abs=0.01)
