"""Walks in tiles against the walk from the start, with tiles so small that guesses fail."""

import random

import numpy as np
import pytest

from strandframe.functions import alignment as A
from strandframe.operators import gaps, walks

SITE = "chrom string, id long, pos int, ref string, alt array<string>, qual double, info map<string,string>"


def made(n, seed, far=(1, 2, 3, 5, 8, 30)):
    rng, rows, at = random.Random(seed), [], {"a": 5, "b": 5}
    for k in range(n):
        c = rng.choice("aab")
        at[c] += rng.choice(far)
        ref = rng.choice("ACGT") + rng.choice(["", "", "", "C", "CG", "TTTTTT"])
        alt = [rng.choice([rng.choice("ACGT") + "G" * (len(ref) - 1), ref + rng.choice("ACGT"), ref[0], "TT"])]
        info = {"DP": str(rng.choice([1, 20, 50])), "DP4": f"{rng.randrange(9)},3,{rng.randrange(4)},{rng.randrange(3)}", "MQ": str(rng.choice([5, 40, 60]))}
        info |= rng.choice([{}, {}, {"PV4": "1e-5,1,1,1"}, {"MXSP": "2000"}, {"G3": "0,0.6,0.4", "HWE": "1e-9"}, {"DP4": "x"[:0] or "5,5,5,5"}])
        rows.append((c, k, at[c], ref if k % 40 else "N", alt if k % 37 else ["."], float(rng.randrange(90)), info))
    return rows


def whole(rows, near=3, reach=10):
    """The same marks by one walk over each contig, written as events over a list of all sites before."""
    out = {}
    for chrom in {r[0] for r in rows}:
        seen = []
        for _, k, pos, ref, alt, qual, info in sorted((r for r in rows if r[0] == chrom), key=lambda r: (r[2], r[1])):
            if alt[0] == "." or ref == "N":
                continue
            gap = any(len(a) != len(ref) for a in alt) if len(ref) > 1 else any(len(a) > 1 for a in alt)
            d = [int(x) for x in info["DP4"].split(",")]
            alts, dp, mark = d[2] + d[3], int(info["DP"]), "PASS"
            if dp < 2:
                mark = "low_depth"
            if alts < 2:
                mark = "few_alt"
            if mark == "PASS" and int(info["MQ"]) < 10:
                mark = "low_mapq"
            if mark == "PASS" and "PV4" in info:
                mark = "bias"
            if mark == "PASS" and "MXSP" in info:
                mark = "extreme"
            if "HWE" in info:
                g = [float(x) for x in info["G3"].split(",")]
                a = 2 * g[0] + g[1]
                if 0 < a < 1 and 1 - g[1] / (a * (1 - a)) < 0:
                    mark = "hwe"
            me = {"id": k, "pos": pos, "end": pos + len(ref) - 1, "gap": gap, "mark": mark, "score": qual * 100 + alts, "ref": ref, "alt": ",".join(alt)}
            if mark == "PASS" and gap:
                for x in seen:
                    if not x["gap"] and x["mark"] == "PASS" and pos - x["end"] <= near:
                        x["mark"] = "near_gap"
                rivals = [x for x in seen if x["gap"] and x["mark"] == "PASS" and pos - x["end"] <= reach]
                stronger = next((i for i, x in enumerate(rivals) if int(x["score"]) >= me["score"]), len(rivals))
                for x in rivals[:stronger]:
                    x["mark"] = "gap_pair"
                if stronger < len(rivals):
                    me["mark"] = "gap_pair"
            elif mark == "PASS":
                x = next((x for x in seen if x["gap"] and pos - x["end"] <= near), None)
                if x:
                    same = len(x["alt"]) == len(x["ref"]) + 1 and x["pos"] + len(x["alt"]) - 1 == pos and x["alt"][-1] == me["alt"][0]
                    (x if same else me)["mark"] = "near_gap"
                rivals = [x for x in seen if not x["gap"] and x["end"] >= pos]
                stronger = next((i for i, x in enumerate(rivals) if int(x["score"]) >= me["score"]), len(rivals))
                for x in rivals[:stronger]:
                    x["mark"] = "mnp_pair"
                if stronger < len(rivals):
                    me["mark"] = "mnp_pair"
            seen.append(me)
        out |= {x["id"]: x["mark"] for x in seen}
    return out


@pytest.mark.parametrize("seed,tile", [(1, None), (2, 20), (3, 20)])
def test_variant_filter(spark, seed, tile):
    rows = made(700, seed)
    got = {r["id"]: r["filter"] for r in walks.variant_filter(spark.createDataFrame(rows, SITE), tile=tile).collect()}
    want = whole(rows)
    assert got == want
    assert {"PASS", "near_gap", "gap_pair", "mnp_pair", "few_alt", "low_depth", "low_mapq", "bias", "extreme", "hwe"} == set(got.values())
    assert walks.variant_filter(spark.createDataFrame([], SITE)).count() == 0


def test_a_chain_longer_than_any_guess(spark):
    """Gaps nine apart: each is dropped by the one before it that stayed, so the marks alternate from the very first site on."""
    rows = [("c", k, 10 + 9 * k, "A", ["AT"], 50.0, {"DP": "20", "DP4": "5,5,5,5", "MQ": "60"}) for k in range(400)]
    asked = []
    real = walks.stored
    try:
        walks.stored = lambda df, name: (asked.append(name), real(df, name))[1]
        got = {r["id"]: r["filter"] for r in walks.variant_filter(spark.createDataFrame(rows, SITE), tile=60).collect()}
    finally:
        walks.stored = real
    assert got == {k: "gap_pair" if k % 2 else "PASS" for k in range(400)} == whole(rows)
    assert any(n.startswith("round") and n != "round0" for n in asked)


@pytest.mark.parametrize("seed", range(4))
def test_two_states_in_tiles(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(900):
        at += rng.choice([1, 1, 1, 1, 2, 7, 60, 100, 101, 300] if rng.random() < 0.1 else [1])
        rows.append((at, rng.choice([1, 9]) if rng.random() < 0.3 else 9 * (at // 60 % 2)))
    want, start = set(), 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] - rows[i - 1][0] > 100:
            own = rows[start:i]
            e = np.array([[-1, 1] if d >= 3 else [1, -1] for _, d in own])
            path = A.two_state_path(e)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], path, [0]])))
            want |= {("c", own[a][0], own[b - 1][0] + 1) for a, b in zip(edge[0::2], edge[1::2], strict=True)}
            start = i
    df = spark.createDataFrame([("c", p, d) for p, d in rows], "chrom string, pos long, depth int")
    for tile in (1 << 14, 64, 7):
        assert {tuple(r) for r in walks.two_state_segments(df, tile=tile).collect()} == want


def test_pileup_filter_in_tiles(spark):
    rng = random.Random(4)
    rows = [("c", p, bool(rng.randrange(3) == 0), rng.randint(5, 60), rng.randint(5, 60), 20, rng.randint(0, 2), rng.choice([0, 3])) for p in sorted(rng.sample(range(3000), 900))]
    df = spark.createDataFrame(rows, "chrom string, pos int, is_gap boolean, quality int, mapq int, depth int, support int, deleted int")
    one, many = ({(r["pos"], r["is_gap"]): r["filter"] for r in gaps.pileup_filter(df, tile=t).collect()} for t in (1 << 20, 40))
    assert one == many and len(set(one.values())) > 3
