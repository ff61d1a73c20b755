"""Queries over whole texts, all reads and all regions, against brute force."""

from collections import Counter, defaultdict
from itertools import groupby, zip_longest

import pytest

from strandframe.model import PILEUP_SKIP
from strandframe.operators import sites
from strandframe.plans import projections as P
from strandframe.plans import queries as q

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """A folder whose documents are of very different lengths, and their sequences."""
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(k, "".join("abcd.bdc-"[(i * (k + 3) + i // 7) % 9] for i in range(n))) for k, n in enumerate((1500, 900, 1200, 401, 0, 450, 1300, 1000, 700))]
    spark.createDataFrame([*docs, (9, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, {k: "".join(dict(zip("abcd", "ACGT", strict=True)).get(x, "N") for x in t) for k, t in docs}


def columns(seqs):
    """seq -> (reference, sequence) letters of every column of the pair."""
    out = {}
    for k in seqs:
        if seqs[k] and seqs.get(k + 1):
            out[k] = [("-" if x == "N" and y in "ACGT" else x, "-" if y == "N" and x in "ACGT" else y) for x, y in zip_longest(seqs[k], seqs[k + 1], fillvalue="-")]
    return out


def op(r, s):
    return "I" if r == "-" else "D" if s == "-" else "M" if r == s else "X"


def test_whole_texts(spark, texts):
    d, seqs = texts
    cols = columns(seqs)
    assert max(map(len, cols.values())) > 900
    got = {r["seq"]: r["seqs"] for r in q.QUERIES["codec_roundtrip"](spark, d).collect()}
    assert got == {k: "".join(s for _, s in c if s != "-") for k, c in cols.items()}
    stats = {r["seq"]: r["matches"] + r["replaces"] + r["insertions"] + r["deletions"] for r in q.QUERIES["codec_stats"](spark, d).collect()}
    assert stats == {k: len(c) for k, c in cols.items()}
    runs = {(r["seq"], r["op"]): (r["columns"], r["runs"]) for r in q.QUERIES["op_runs"](spark, d).collect()}
    want = {}
    for k, c in cols.items():
        ops = [op(r, s) for r, s in c]
        for o, n in Counter(ops).items():
            want[k, o] = (n, sum(x == o for x, _ in groupby(ops)))
    assert runs == want
    changed = defaultdict(int)
    for k, c in cols.items():
        for p, (r, s) in enumerate(x for x in c if x[0] != "-"):
            changed[k // 8, p] |= r != s
    got = sorted((r["corpus"], r["pos"]) for r in q.QUERIES["sync_map"](spark, d).collect())
    assert got == [(g, p) for g, p in sorted(changed) if p and changed[g, p - 1] and not changed[g, p]] and got
    cycles = {r["cycle"]: (r["gc"], r["total"]) for r in q.QUERIES["gc_by_cycle"](spark, d).collect()}
    at = lambda p: [s[p] for s in seqs.values() if len(s) > p]
    assert cycles == {p: (sum(x in "GC" for x in at(p)), len(at(p))) for p in range(1500)}


def test_linkage_of_all_pairs(spark):
    pl = P.likelihoods(spark, SF).where("site < 30")
    want = {(r["a"], r["b"]): r["r2"] for r in sites.linkage_window(pl, 30).collect()}
    for block in (7, 256):
        got = sites.linkage_matrix(pl, block).collect()
        assert len(got) == 30 * 31 // 2 and {(r["a"], r["b"]): r["r2"] for r in got} == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def reads(spark):
    return [r.asDict() for r in P.reads(spark, SF).collect()]


def test_whole_reads(spark, reads):
    run = lambda name: q.QUERIES[name](spark, SF).collect()
    pile = defaultdict(list)
    for r in reads:
        if not r["flag"] & PILEUP_SKIP:
            for p in range(r["pos"], r["e"]):
                pile[r["tid"], p].append(r)
    assert len({t for t, _ in pile}) == 5
    assert {(r["tid"], r["pos"]): (r["n"], r["heads"], r["tails"], r["qpos"]) for r in run("pileup_counts")} == {
        (t, p): (len(x), sum(r["pos"] == p for r in x), sum(r["e"] - 1 == p for r in x), sum(p - r["pos"] for r in x)) for (t, p), x in pile.items()
    }
    good = Counter({k: sum((r["qid"] * 3 + k[1]) % 41 >= 13 for r in x) for k, x in pile.items()})
    assert {(r["tid"], r["pos"]): r["n"] for r in run("mpileup_text")} == {k: n for k, n in good.items() if n}
    strands = lambda k, x: tuple(sum((("ACGT"[(r["qid"] + k[1]) % 4] != "A"), bool(r["flag"] & 16)) == w for r in x) for w in ((False, False), (False, True), (True, False), (True, True)))
    assert {(r["tid"], r["pos"]): (r["rf"], r["rr"], r["af"], r["ar"]) for r in run("site_annotation")} == {k: strands(k, x) for k, x in pile.items()}
    assert {(r["tid"], r["pos"]): r["depth"] for r in run("haploid_consensus")} == {k: min(len(x), 255) for k, x in pile.items()}
    assert {(r["tid"], r["pos"]) for r in run("site_bias")} == {(r["tid"], r["pos"]) for r in run("site_likelihoods")} == set(pile)
    assert sorted(r["site"] for r in run("fisher_strand")) == sorted((t << 32) + p for t, p in pile)
    assert {r["tid"] for r in run("phase_sets")} == set(range(5))
    assert len(run("group_association")) == 500
    assert Counter(r["ord"] for r in run("cat")) == Counter(r["ord"] for r in reads)
    assert Counter((r["ord"], r["file"]) for r in run("merge_tagged")) == Counter((r["ord"], r["qid"] % 2) for r in reads)


def test_whole_regions(spark, reads):
    by = defaultdict(list)
    for r in P.regions(spark, SF).collect():
        by[r["tid"]].append((r["b"], r["e"]))
    want = set()
    for t, spans in by.items():
        islands = []
        for b, e in sorted(spans):
            if islands and b <= islands[-1][1]:
                islands[-1][1] = max(e, islands[-1][1])
            else:
                islands.append([b, e])
        want |= {(t, b, e) for b, e in islands}
    assert {(r["tid"], r["b"], r["e"]) for r in q.QUERIES["merged_regions"](spark, SF).collect()} == want
    hit = [r["ord"] for r in reads if r["e"] > r["pos"] and any(r["pos"] < e and b < r["e"] for b, e in by[r["tid"]])]
    assert Counter(r["ord"] for r in q.QUERIES["bed_semi_join"](spark, SF).collect()) == Counter(hit)
