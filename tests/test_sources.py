import pytest
from pyspark.sql import functions as F

from strandframe.functions import reads as R
from strandframe.operators import consensus, depth, intervals
from strandframe.sources import binary, sequence_index, text

SAM = """@HD\tVN:1.4\tSO:unsorted
@SQ\tSN:c1\tLN:50
@SQ\tSN:c2\tLN:40
a1\t99\tc1\t5\t30\t4M2I3M1D2M\t=\t20\t26\tACGTTTGGGCC\tIIIIIIIIIII\tRG:Z:g1\tNM:i:3
a1\t147\tc1\t20\t30\t5M\t=\t5\t-26\tACGTN\t*\tXB:B:S,1,2,300
a2\t0x4\t*\t0\t0\t*\t*\t0\t0\tAC\tII
a3\t16\tc2\t2\t60\t2S3M5N2M1H\t*\t0\t0\tTTacgGG\tIIIIIII
"""


@pytest.fixture
def sam(tmp_path):
    p = tmp_path / "x.sam"
    p.write_text(SAM)
    return str(p)


def test_read_and_write(spark, sam):
    r = text.read_sam(spark, sam).orderBy("ord").collect()
    assert [x["qname"] for x in r] == ["a1", "a1", "a2", "a3"]
    assert r[0]["pos"] == 4 and r[0]["rnext"] == "c1" and r[2]["flag"] == 4 and r[1]["qual"] is None
    assert r[0]["tags"]["NM"]["value"] == "3" and r[1]["tags"]["XB"]["value"] == "S,1,2,300"
    lines = [x["value"] for x in text.format_sam(text.read_sam(spark, sam).orderBy("ord")).collect()]
    want = [x.replace("0x4", "4") for x in SAM.strip().split("\n")[3:]]
    assert [sorted(x.split("\t")) for x in lines] == [sorted(x.split("\t")) for x in want]
    h = text.read_sam_header(spark, sam).orderBy("line_no").collect()
    assert [x["type"] for x in h] == ["HD", "SQ", "SQ"] and h[1]["tags"]["LN"] == "50"


def test_bad_lengths(spark, tmp_path):
    p = tmp_path / "bad.sam"
    p.write_text("q\t0\tc\t1\t9\t4M\t*\t0\t0\tACG\t*\n")
    with pytest.raises(Exception, match="differ in length"):
        text.read_sam(spark, str(p)).collect()


def test_binary_round_trip(spark, sam, tmp_path):
    rows = text.read_sam(spark, sam).orderBy("ord").collect()
    p = tmp_path / "x.bam"
    p.write_bytes(binary.encode(rows, [("c1", 50), ("c2", 40)], "@HD\tVN:1.4\n"))
    binary.register(spark)
    got = spark.read.format("bam").load(str(p)).orderBy("ord").collect()
    for a, b in zip(rows, got, strict=True):
        assert (a["qname"], a["flag"], a["rname"], a["pos"], a["mapq"], a["cigar"], a["tlen"], a["qual"], a["tags"]) == (b["qname"], b["flag"], b["rname"], b["pos"], b["mapq"], b["cigar"], b["tlen"], b["qual"], b["tags"])
        assert (a["seq"] or "").upper() == (b["seq"] or "")


def test_expressions(spark, sam):
    r = text.read_sam(spark, sam).withColumns({"end": R.reference_end("pos", "cigar"), "ql": R.query_length("cigar"), "mi": R.aligned_and_inserted("cigar"), "fs": R.flag_string("flag"), "bin": R.bin_of("pos", R.reference_end("pos", "cigar"))})
    got = {(x["qname"], x["pos"]): x for x in r.collect()}
    assert got["a1", 4]["end"] == 14 and got["a1", 4]["ql"] == 11 and got["a1", 4]["mi"] == 11
    assert got["a3", 1]["end"] == 11 and got["a3", 1]["ql"] == 7 and got["a1", 4]["fs"] == "pPR1" and got["a1", 4]["bin"] == 4681
    region = spark.range(1).select(R.parse_region(F.lit("chr:1:1,000-2,000")).alias("x")).first()["x"]
    assert tuple(region) == ("chr:1", 999, 2000)
    keys = spark.createDataFrame([("a10",), ("a9",), ("a010",), ("b1",), ("a",)], "n string").orderBy(R.natural_key("n")).collect()
    assert [k["n"] for k in keys] == ["a", "a9", "a010", "a10", "b1"]
    x = spark.createDataFrame([("ab",)], "n string").select(R.x31("n").alias("h")).first()["h"]
    assert x == 97 * 31 + 98
    t = spark.createDataFrame([([30] * 40 + [2] * 10,)], "q array<int>").select(R.trim_length("q", 20).alias("t")).first()["t"]
    assert t == 10


def test_exports(spark, sam):
    r = text.read_sam(spark, sam)
    fq = {x["value"].split("\n")[0]: x["value"].split("\n")[1] for x in text.to_fastq(r).collect()}
    assert fq["@a1/1"] == "ACGTTTGGGCC" and fq["@a1/2"] == "NACGT" and fq["@a3"] == "CCcgtAA"
    bed = {(x["name"], x["strand"]): (x["beg"], x["end"]) for x in text.to_bed(r).collect()}
    assert bed["a1", "+"] == (4, 14) and bed["a3", "-"] == (1, 11)


def test_pileup_of_cigar(spark, sam):
    p = depth.pileup_cigar(text.read_sam(spark, sam).where("qname = 'a1' and pos = 4")).orderBy("p").collect()
    assert [x["p"] for x in p] == list(range(4, 14))
    assert "".join(x["base"] for x in p) == "ACGTGGG*CC"
    assert [x["indel"] for x in p] == [0, 0, 0, 2, 0, 0, -1, 0, 0, 0]


def test_consensus(spark, sam):
    ref = spark.createDataFrame([("c1", "A" * 25)], "name string, seq string")
    r = text.read_sam(spark, sam).where("rname = 'c1'")
    x = consensus.pairwise(r, ref).first()
    assert x["ref_aln"].replace("-", "") == "A" * 25 and x["seq_aln"].startswith("NNNNACGTTTGGG-CC") and len(x["ref_aln"]) == len(x["seq_aln"])


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">one first\nACGT\nAC\n>two\nGGNN\n")
    got = {r["name"]: r["seq"] for r in text.read_fasta(spark, str(p), strict=True).collect()}
    assert got == {"one": "ACGTAC", "two": "GGNN"}
    idx = {r["name"]: (r["len"], r["offset"], r["line_bases"], r["line_bytes"]) for r in sequence_index.sequence_index(spark, str(p)).collect()}
    assert idx == {"one": (6, 11, 4, 5), "two": (4, 24, 4, 5)}
    out = text.format_fasta(spark.createDataFrame([("n", "A" * 130)], "name string, seq string")).first()["value"]
    assert out == ">n\n" + "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 10
    (tmp_path / "aln.fa").write_text(">r\nAC-GT\n>s\nACTG-\n")
    a = text.read_alignment(spark, str(tmp_path / "aln.fa")).first()
    assert (a["ref_aln"], a["seq_aln"]) == ("AC-GT", "ACTG-")
    (tmp_path / "one.fa").write_text(">r\nACGT\n")
    with pytest.raises(Exception, match="two records"):
        text.read_alignment(spark, str(tmp_path / "one.fa")).collect()


def test_bed_and_vcf(spark, tmp_path):
    (tmp_path / "x.bed").write_text("# c\nchr1\t5\t9\textra\nchr2\t7\n")
    assert {tuple(r) for r in text.read_bed(spark, str(tmp_path / "x.bed")).collect()} == {("chr1", 5, 9), ("chr2", 6, 7)}
    line = "c\t10\t.\tA\tC,G\t30.5\tPASS\tDB;DP=3\tGT:PL\t0/1:1,0,9\t./."
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.1\n#CHROM\n" + line + "\n")
    v = text.read_vcf(spark, str(tmp_path / "x.vcf"))
    r = v.first()
    assert r["pos"] == 9 and r["alt"] == ["C", "G"] and r["info"] == {"DB": None, "DP": "3"} and r["samples"][0] == {"GT": "0/1", "PL": "1,0,9"}
    assert text.format_vcf(v).first()["value"] == line + ":."


def test_overlaps_against_brute_force(spark):
    import random

    rng = random.Random(8)
    reads = [(i, rng.randrange(2), b := rng.randrange(400), b + rng.randrange(0, 40)) for i in range(200)]
    regs = [(i, rng.randrange(2), b := rng.randrange(400), b + rng.randrange(0, 150)) for i in range(12)]
    r, g = spark.createDataFrame(reads, "ord long, tid int, pos int, e int"), spark.createDataFrame(regs, "rid long, tid int, b int, e int")
    hit = {(x[0], y[0]) for x in reads for y in regs if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[3] > x[2] and y[3] > y[2]}
    assert {(x["ord"], x["rid"]) for x in intervals.fetch_regions(r, g).collect()} == hit
    for width in (8, 64, 4096):
        got = [x["ord"] for x in intervals.overlap_semi(r, g, width=width).collect()]
        assert len(got) == len(set(got)) and set(got) == {a for a, _ in hit}
    cov = {x["rid"]: x["cov"] for x in intervals.coverage(r, g).collect()}
    assert cov == {y[0]: sum(max(0, min(x[3], y[3]) - max(x[2], y[2])) for x in reads if x[1] == y[1]) for y in regs}


def test_sequence_index_over_ranges(spark, tmp_path):
    import random

    rng, p = random.Random(1), tmp_path / "many.fa"
    out, want = "", {}
    for k in range(120):
        n, width = rng.choice([0, 1, 59, 60, 61, 700, 5000]), rng.choice([60, 7, 4000])
        end = rng.choice(["\n", "\r\n"])
        out += f">s{k} and more{end}"
        body = "".join("A" * min(width, n - i) + end for i in range(0, n, width))
        want[f"s{k}"] = (n, len(out), min(width, n), min(width, n) + len(end) if n else 0)
        out += body + rng.choice(["", "\n"])
    p.write_bytes(out.encode())
    for split in (1 << 25, 4096, 333, 50):
        got = {r["name"]: (r["len"], r["offset"], r["line_bases"], r["line_bytes"]) for r in sequence_index.sequence_index(spark, str(p), split).collect()}
        assert got == want
    p.write_text(">a\nACGT\nAC\nACGT\n")
    for split in (100, 8, 3):
        with pytest.raises(Exception, match="differ in length"):
            sequence_index.sequence_index(spark, str(p), split).collect()
