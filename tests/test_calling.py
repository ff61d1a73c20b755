import random
import time
from itertools import product

import numpy as np
import pytest

from strandframe.functions.phasing import misfits, phase
from strandframe.operators import calling
from strandframe.plans import projections as P
from strandframe.sources import sites_binary, store, text


def test_phase_by_enumeration():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(2, 7)
        truth = [rng.randint(0, 1) for _ in range(n)]
        frags = []
        for _ in range(rng.randint(1, 12)):
            b = rng.randrange(n - 1)
            side = rng.randint(0, 1)
            frags.append({s: truth[s] ^ side ^ (rng.random() < 0.1) for s in range(b, min(n, b + rng.randint(2, 4)))})
        cost = lambda h: sum(min(m := sum(h[s] != a for s, a in f.items()), len(f) - m) for f in frags if len(f) > 1)  # noqa: E731, B023
        got = phase(n, frags)
        assert got[0] == 0 and cost(got) == min(cost((0, *h)) for h in product((0, 1), repeat=n - 1))
    assert phase(0, []) == []


def test_phase_counts_alike_fragments():
    """Cost follows the fragments that differ: misfits of counted fragments are those of the copies, and many fragments take seconds."""
    rng = random.Random(5)
    frags = [{s: rng.randint(0, 1) for s in rng.sample(range(b, b + 8), rng.randint(2, 4))} for b in (rng.randrange(32) for _ in range(20_000))]
    began = time.monotonic()
    got = phase(40, frags)
    assert time.monotonic() - began < 15 and len(got) == 40 and got[0] == 0
    mask, bits, n = np.array([0b101, 0b11]), np.array([0b100, 0b11]), np.array([3, 2])
    assert (misfits(mask, bits, n) == misfits(mask.repeat(n), bits.repeat(n), np.ones(5, int))).all()
    assert misfits(mask, bits, n, 3).tolist() == [3, 2, 5, 0, 0, 5, 2, 3]


def test_sites_from_piles(spark):
    rows = [(0, 5, 0, "A", "A", 30, 60, 0)] * 10 + [(0, 5, 0, "A", "G", 30, 60, 16)] * 10 + [(0, 6, 0, "C", "C", 30, 60, 0)] * 8 + [(0, 5, 1, "A", "A", 30, 60, 0)] * 6
    pile = spark.createDataFrame(rows, "tid int, p int, sample int, ref string, base string, baseq int, mapq int, flag int")
    got = {r["pos"]: r for r in calling.site_likelihoods(pile).collect()}
    assert got[5]["alts"] == ["G", "X"] and got[5]["dp"] == [20, 6] and got[5]["pl"][0][1] == 0 and got[5]["pl"][1][0] == 0
    assert got[6]["alts"] == ["X"] and got[6]["pl"][0] == [0, *got[6]["pl"][0][1:]] and min(got[6]["pl"][0][1:]) > 0
    c = {r["pos"]: (r["base"], r["qual"], r["depth"]) for r in calling.haploid_consensus(pile).collect()}
    assert c[5] == ("A", 63, 26) and c[6] == ("C", 63, 8)


def test_calls(spark):
    pl = [[[0, 40, 80]] * 5, [[0, 40, 80]] * 2 + [[40, 0, 40]] * 3]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pl)], "site long, pl array<array<int>>")
    got = {r["site"]: r for r in calling.call_sites(df).collect()}
    assert got[0]["ac1"] == 0 and got[0]["p_ref"] > 0.99 and got[1]["ac1"] == 3 and got[1]["gts"][-1] == "0/1" and got[1]["qual"] > 50
    t = {r["site"]: r["clr"] for r in calling.pair_and_trio(df).collect()}
    assert t[0] == 0


def test_phase_sets(spark):
    rows = [(0, f, p, a) for f, obs in enumerate([{1: 0, 5: 1}, {5: 0, 9: 0}, {1: 1, 9: 0}, {100: 1, 110: 1}, {300: 1}]) for p, a in obs.items()]
    got = {r["pos"]: (r["ps"], r["phase"]) for r in calling.phase_sets(spark.createDataFrame(rows, "tid int, frag int, pos int, allele int")).collect()}
    assert {k: v for k, v in got.items() if k < 200} == {1: (1, 0), 5: (1, 1), 9: (1, 1), 100: (100, 0), 110: (100, 0)}


def test_binary_sites(spark, tmp_path):
    line = "c\t10\t.\tA\tC,G\t30.5\tPASS\tDB;DP=3\tGT:PL:GQ\t0/1:1,0,9,8,7,6:40\t.|.:0,0,0,0,0,0:0\nd\t2\trs\tT\t.\t.\t.\t.\tGT:PL:GQ\t0|0:0:3\t1/1:5:4"
    (tmp_path / "x.vcf").write_text(line + "\n")
    rows = text.read_vcf(spark, str(tmp_path / "x.vcf")).collect()
    (tmp_path / "x.bcf").write_bytes(sites_binary.encode(rows, ["c", "d"], ["s1", "s2"], "##x"))
    sites_binary.register(spark)
    got = spark.read.format("bcf").load(str(tmp_path / "x.bcf")).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in rows]
    with pytest.raises(ValueError):
        sites_binary.encode([rows[0].asDict() | {"samples": [{"PL": "1"}]}], ["c", "d"], ["s1"])


def test_concatenated_sites(spark, tmp_path):
    line = "c\t10\t.\tA\tC\t30.5\tPASS\tDB\tGT:GQ\t0/1:40"
    (tmp_path / "x.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n" + line + "\n")
    rows = text.read_vcf(spark, str(tmp_path / "x.vcf")).collect()
    for name, samples in (("a", ["s1"]), ("b", ["s1"]), ("z", ["s2"])):
        (tmp_path / f"{name}.bcf").write_bytes(sites_binary.encode(rows, ["c", "d"], samples))
    paths = [str(tmp_path / f"{k}.bcf") for k in "ab"]
    assert sorted((r.file, r.pos) for r in store.concatenate_sites(spark, paths).collect()) == [(0, 9), (1, 9)]
    assert store.sample_names(spark, str(tmp_path / "x.vcf")) == ["s1"] and store.sample_names(spark, paths[0]) == ["s1"]
    with pytest.raises(ValueError):
        store.concatenate_sites(spark, [paths[0], str(tmp_path / "z.bcf")])


def test_projection_of_likelihoods(spark):
    sites = P.likelihoods(spark, "/root/testdata/sf0.001").where("site < 5")
    assert calling.call_sites(sites).count() == 5
