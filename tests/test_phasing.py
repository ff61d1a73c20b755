"""Sides, cuts, support and masks against loops over fragments and sites."""

import random
from collections import Counter

import pytest

from strandframe.operators import phasing

OBS, SITES = "tid int, frag long, pos int, allele int", "tid int, ps int, pos int, phase int"


def made(seed):
    rng = random.Random(seed)
    phase = {p: rng.randrange(2) for p in range(0, 600, 5)}
    obs = {}
    for f in range(150):
        b, n, side = rng.randrange(0, 90), rng.randint(1, 24), rng.randrange(2)
        chimera = rng.randrange(n) if n > 12 and f % 3 == 0 else n
        for i in range(n):
            obs[f, 5 * (b + i)] = phase[5 * (b + i)] ^ side ^ (i >= chimera) ^ (rng.random() < 0.08)
    return phase, obs


def brute(phase, obs, repair=True):
    out = {}
    for f in {f for f, _ in obs}:
        ps = sorted(p for g, p in obs if g == f)
        same = [obs[f, p] == phase[p] for p in ps]
        side = 0 if 2 * sum(same) > len(ps) else 1
        ok = [s == (side == 0) for s in same]
        a, d = sum(ok), len(ok) - sum(ok)
        cut = tail = None
        if repair and min(a, d) >= 3:
            best = max(((w := [sum(ok[: i + 1]) + (t := [not x for x in ok[i + 1 :]]).count(True) - 2 * t.count(False), ok[: i + 1].count(False) + ok[i + 1 :].count(True) - 2 * ok[i + 1 :].count(False)], max(w), -i) for i in range(len(ok) - 1)), key=lambda x: x[1:])
            if best[1] - max(a, d) >= 4:
                cut, tail = ps[-best[2]], best[0][0] > best[0][1]
        out[f] = (len(ps), side, a, d, a != d, a > 0 and 0 < d < 3 and a <= d + 1, cut, tail)
    return out


def frames(spark, phase, obs):
    return spark.createDataFrame([(0, f, p, int(a)) for (f, p), a in obs.items()], OBS), spark.createDataFrame([(0, 0, p, x) for p, x in phase.items()], SITES)


@pytest.mark.parametrize("seed", [1, 2])
def test_fragments_cuts_and_support(spark, seed):
    phase, obs = made(seed)
    o, s = frames(spark, phase, obs)
    fr = phasing.fragment_phases(o, s)
    got = {r["frag"]: tuple(r)[3:] for r in fr.collect()}
    want = brute(phase, obs)
    assert got == want and sum(v[6] is not None for v in want.values()) > 5 and {v[7] for v in want.values()} == {None, True, False}
    mended = {(f, p): a ^ (want[f][6] is not None and (p > want[f][6]) == want[f][7]) for (f, p), a in obs.items()}
    m = phasing.repaired(o, fr)
    assert {(r["frag"], r["pos"]): r["allele"] for r in m.collect()} == {k: int(v) for k, v in mended.items()}
    again = brute(phase, mended, False)
    counts = Counter()
    for (f, p), a in mended.items():
        if again[f][0] > 1:
            counts[p, again[f][1], (a == phase[p]) == (again[f][1] == 0)] += 1
    sup = phasing.site_support(m, s, phasing.fragment_phases(m, s, repair=False)).collect()
    assert {r["pos"]: tuple(r)[3:] for r in sup} == {p: (counts[p, 0, True], counts[p, 0, False], counts[p, 1, True], counts[p, 1, False]) for p in phase}
    parts = {r["frag"]: (r["part"], r["phased"]) for r in phasing.split_reads(o.select("tid", "frag").distinct(), fr, drop_ambiguous=True).collect()}
    for f, v in want.items():
        assert parts[f] == ((2, False) if v[5] or (v[4] and v[6] is not None) else (v[1], True) if v[4] else (parts[f][0], False))


def brute_masks(scores, least):
    out, i, n = [], 0, len(scores)
    while i < n:
        run, best, at, beg = 0, 0, None, None
        j = i
        while j < n:
            was, run = run, max(0, run + scores[j][1])
            if was == 0 and run > 0:
                beg, best, at = j, 0, None
            if run > best:
                best, at = run, j
            if run == 0 and best >= least:
                break
            if run == 0:
                best = 0
            j += 1
        if best < least:
            break
        out.append((scores[beg][0], scores[at][0], best))
        i = at + 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_masked_regions(spark, seed):
    rng = random.Random(seed)
    rows = [(t, ps, 7 * k, rng.choice([-6, -2, -1, -1, 1, 2, 3])) for t in (0, 1) for ps in (0, 9) for k in range(ps, 3000, 10)]
    got = {tuple(r) for r in phasing.masked_regions(spark.createDataFrame(rows, "tid int, ps int, pos int, score long"), 4).collect()}
    want = {(t, ps, *m) for t in (0, 1) for ps in (0, 9) for m in brute_masks([(p, s) for a, b, p, s in rows if (a, b) == (t, ps)], 4)}
    assert got == want and len(want) > 20
    assert phasing.masked_regions(spark.createDataFrame([(0, 0, 1, -3)], "tid int, ps int, pos int, score long")).count() == 0
