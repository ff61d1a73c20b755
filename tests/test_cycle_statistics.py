"""Mismatches and gaps by cycle, depth by share of G and C, and marker lists as sites: each against plain loops or cases by hand."""

from collections import Counter

import numpy as np

from strandframe.operators import cycle_statistics as S
from strandframe.operators import sites

READS = "qname string, flag int, rname string, pos int, mapq int, cigar array<struct<len:int,op:string>>, seq string, qual string, ord long"
REF = "ACGTNACGTACGTTTACG" * 40


def rows():
    rng = np.random.default_rng(4)
    out = []
    for k in range(60):
        cigar = [[(12, "M")], [(2, "S"), (5, "M"), (1, "I"), (6, "M")], [(4, "="), (2, "D"), (8, "M")], [(3, "M"), (7, "N"), (9, "X"), (2, "H")]][k % 4]
        n = sum(x for x, o in cigar if o in "MIS=X")
        seq = "".join(rng.choice(list("ACGTN"), n))
        flag = (16 if k % 3 == 0 else 0) | (128 if k % 5 == 0 else 0) | (4 if k == 7 else 0) | (256 if k == 11 else 0)
        out.append((f"q{k}", flag, "c", int(rng.integers(0, 600)), 9, cigar, seq, None if k == 13 else "".join(chr(33 + x) for x in rng.integers(0, 40, n)), k))
    return out


def test_by_cycle(spark):
    reads = spark.createDataFrame(rows(), READS)
    reference = spark.createDataFrame([("c", REF)], "name string, seq string")
    wrong, gaps = Counter(), Counter()
    for _, flag, _, pos, _, cigar, seq, qual, _ in rows():
        if flag & (4 | 256):
            continue
        turn = lambda y, n=len(seq), back=flag & 16: n - 1 - y if back else y
        x, y = pos, 0
        for n, op in cigar:
            for i in range(n if op in "M=X" else 0):
                if seq[y + i] == "N":
                    wrong[turn(y + i), -1] += 1
                elif REF[x + i] not in ("N", seq[y + i]):
                    wrong[turn(y + i), 255 if qual is None else ord(qual[y + i]) - 33] += 1
            if op == "I":
                gaps["I", len(seq) - y - n if flag & 16 else y, 2 if flag & 128 else 1] += 1
            if op == "D":
                gaps["D", (len(seq) - y if flag & 16 else y) - 1, 2 if flag & 128 else 1] += 1
            x, y = x + n * (op in "MDN=X"), y + n * (op in "MIS=X")
    assert {(r.cycle, r.qual): r.n for r in S.mismatches_by_cycle(reads, reference).collect()} == wrong
    got = S.gaps_by_cycle(reads, reference).collect()
    assert Counter({k: n for r in got for k, n in ((("I", r.cycle, r.read), r.insertions), (("D", r.cycle, r.read), r.deletions)) if n}) == gaps
    assert S.mismatches_by_cycle(reads.limit(0), reference).count() == 0


def test_gc_depth(spark):
    reads = spark.createDataFrame(rows(), READS)
    windows: dict = {}
    for _, flag, _, pos, _, _, seq, _, _ in rows():
        if not flag & (4 | 256):
            w = windows.setdefault(pos // 50, [0, 0])
            w[0] += sum(x in "GC" for x in seq)
            w[1] += len(seq)
    by: dict = {}
    for g, n in windows.values():
        by.setdefault(100 * g // n, []).append(n / 50)
    got = {r.gc: r for r in S.gc_depth(reads, 50, (0.1, 0.5)).collect()}
    assert {k: (r.windows, r.p10, r.p50) for k, r in got.items()} == {k: (len(v), round(float(np.quantile(v, 0.1)), 6), round(float(np.quantile(v, 0.5)), 6)) for k, v in by.items()}


def test_marker_sites(spark):
    m = [("c", 9, "a", "+", "A", "A/C/G", "genomic", "single", "unknown", 0.0), ("c", 9, "b", "-", "T", "A/C", "genomic", "single", "by-x", 0.25), ("c", 9, "d", "-", "C", "-/GT", "cDNA", "in-del", None, None), ("c", 9, "e", "+", "-", "-/AC", "cDNA", "insertion", "unknown", 0.0)]
    names = "chrom string, start long, name string, strand string, ref string, observed string, molecule string, class string, valid string, frequency double"
    got = {r.id: r for r in sites.marker_sites(spark.createDataFrame(m, names)).collect()}
    assert [(got[k].pos, got[k].ref, got[k].alt) for k in "abde"] == [(9, "A", ["C", "G"]), (9, "T", ["G"]), (8, "NC", ["NAC", "N"]), (8, "N", ["NAC"])]
    assert got["a"].info == {"molType": "genomic", "class": "single"} and got["b"].info == {"molType": "genomic", "class": "single", "valid": "by-x", "AF": "0.25"}


def _one_by_one(rows):
    """(kind, cycle, value) of each mismatch and gap, a read and an operation at a time."""
    for x in rows:
        back, n, y, at = x["flag"] & 16, len(x["seq"]), 0, x["pos"] - x["t0"]
        for op in x["cigar"]:
            size, kind = op["len"], op["op"]
            if kind in "M=X":
                for k in range(size):
                    r = x["parts"][at + k].upper() if at + k < len(x["parts"]) else None
                    a = x["seq"][y + k].upper()
                    if r and (a == "N" or a != r != "N"):
                        yield 0, n - 1 - y - k if back else y + k, -1 if a == "N" else 255 if x["qual"] in (None, "*") else ord(x["qual"][y + k]) - 33
            elif kind in "ID":
                read = 2 if x["flag"] & 128 else 1
                yield (1, n - y - size if back else y, read) if kind == "I" else (2, (n - y if back else y) - 1, read)
            y += size if kind in "MIS=X" else 0
            at += size if kind in "MDN=X" else 0


def test_batches_are_counted_as_operations_are():
    import random
    from collections import Counter

    import pyarrow as pa
    from strandframe.operators import cycle_statistics as C

    rng, rows = random.Random(8), []
    for k in range(400):
        cigar = [{"len": rng.randint(1, 9), "op": rng.choice("MMM=XIDNSHP")} for _ in range(rng.randint(1, 6))]
        n = sum(o["len"] for o in cigar if o["op"] in "MIS=X")
        text = lambda of, n: "".join(rng.choices(of, k=n))
        rows.append({"pos": k, "flag": rng.choice([0, 16, 128, 144]), "cigar": cigar, "seq": text("ACGTNacgné", n), "qual": [text("!5I~", n), "*", None][min(k % 9, 2) if k % 9 else 0], "t0": k - k % 3, "parts": text("ACGTNacgtñ", rng.randint(0, 60))})
    kinds = pa.schema([("pos", pa.int32()), ("flag", pa.int32()), ("cigar", pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))), ("seq", pa.string()), ("qual", pa.string()), ("t0", pa.int32()), ("parts", pa.string())])
    batch = pa.RecordBatch.from_pylist(rows, schema=kinds)
    fold = lambda x: x | {"seq": x["seq"].replace("é", "?"), "parts": x["parts"].replace("ñ", "?")}
    for lo, n in ((0, 400), (7, 100), (3, 0)):
        got, count = C._counts_of_batch(batch.slice(lo, n))
        assert dict(zip(map(tuple, got.tolist()), count.tolist(), strict=True)) == Counter(_one_by_one(map(fold, rows[lo : lo + n])))
