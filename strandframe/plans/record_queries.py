"""Registered queries over whole records: reads with CIGAR, sequence, qualities and tags, site lines, and the text and binary
formats written to the shared folder and read again; with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reads as R
from ..model import CONSENSUS_SKIP, PILEUP_SKIP
from ..operators import consensus, cycle_statistics, depth, gap_calls, gaps, headers, quality, records, sites, tiles, walks
from ..sources import binary, blocks, read_index, sequence_index, sites_binary, store, text
from ..sources.shared import shared_path
from . import projections as P
from .queries import _PILE, _with_bases, query

#: Every contig's letters, over and over; the bases and qualities of a read are a window of these.
REFERENCE, LENGTH = "GATTACAGGT", 4000
_SEQ, _QUAL = "ACGTTGCAAT", "5:?DI+!"
CONTIGS = [(f"chr{k}", LENGTH) for k in range(5)]


def whole_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads as records: every fifth template each as one match, with an insertion, a deletion, clipped ends, a skip."""
    r = P.reads(spark, d).selectExpr("*", "e - pos AS l").selectExpr("*", "CASE WHEN qid % 5 IN (1, 2, 4) AND l < 4 THEN 0 ELSE qid % 5 END AS kind", "CAST(l DIV 2 AS int) AS a")
    op = lambda *xs: "array(" + ", ".join(f"named_struct('len', CAST({n} AS int), 'op', '{o}')" for n, o in xs) + ")"
    forms = [op(("l", "M")), op(("a", "M"), (2, "I"), ("l - a", "M")), op(("a", "M"), (3, "D"), ("l - a", "M")), op((2, "S"), ("l", "M"), (1, "S")), op(("a", "M"), (5, "N"), ("l - a", "M"))]
    r = r.selectExpr("*", "CASE kind " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(forms)) + " END AS cigar", "CAST(l + CASE kind WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS int) AS n")
    tag = lambda k, v: f"named_struct('type', '{k}', 'value', CAST({v} AS string))"
    return r.selectExpr(
        "ord", "qid", "concat('read', qid) AS qname", "flag", "concat('chr', tid) AS rname", "pos + 1200 AS pos", "mapq", "cigar", "concat('chr', qid % 5) AS rnext", "pos + 1300 AS pnext", "CAST(qid * 7 % 500 - 100 AS int) AS tlen",
        f"substring(repeat('{_SEQ}', 8), CAST(qid % 10 + 1 AS int), n) AS seq", f"substring(repeat('{_QUAL}', 12), CAST(qid % 7 + 1 AS int), n) AS qual",
        f"CASE WHEN qid % 7 = 0 THEN map('NM', {tag('i', 'mapq % 4')}) ELSE map('NM', {tag('i', 'mapq % 4')}, 'RG', {tag('Z', '''concat('g', qid % 3)''')}) END AS tags",
    )


RECORDS = f"""shapes AS (SELECT *, e - pos AS l, (e - pos) // 2 AS a, CASE WHEN qid % 5 IN (1, 2, 4) AND e - pos < 4 THEN 0 ELSE qid % 5 END AS kind FROM reads),
sized AS (SELECT *, cast(l + CASE kind WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS int) AS n,
  CASE kind WHEN 0 THEN l || 'M' WHEN 1 THEN a || 'M2I' || (l - a) || 'M' WHEN 2 THEN a || 'M3D' || (l - a) || 'M' WHEN 3 THEN '2S' || l || 'M1S' ELSE a || 'M5N' || (l - a) || 'M' END AS cigar FROM shapes),
records AS (SELECT ord, qid, kind, l, a, n, 'read' || qid AS qname, flag, 'chr' || tid AS rname, pos + 1200 AS pos, mapq, cigar, 'chr' || (qid % 5) AS rnext, pos + 1300 AS pnext, cast(qid * 7 % 500 - 100 AS int) AS tlen,
  substr(repeat('{_SEQ}', 8), cast(qid % 10 + 1 AS int), n) AS seq, substr(repeat('{_QUAL}', 12), cast(qid % 7 + 1 AS int), n) AS qual,
  CASE WHEN qid % 7 = 0 THEN NULL ELSE 'g' || (qid % 3) END AS rg, cast(mapq % 4 AS varchar) AS nm FROM sized)"""

#: A row for each block of a record: operation, span on the reference from pos, first base, and the indel after it.
BLOCKS = """blocks AS (SELECT *, unnest(CASE kind WHEN 0 THEN [{o: 'M', b: 0, e: l, q: 0, i: 0}] WHEN 3 THEN [{o: 'M', b: 0, e: l, q: 2, i: 0}]
  WHEN 1 THEN [{o: 'M', b: 0, e: a, q: 0, i: 2}, {o: 'M', b: a, e: l, q: a + 2, i: 0}]
  WHEN 2 THEN [{o: 'M', b: 0, e: a, q: 0, i: -3}, {o: 'D', b: a, e: a + 3, q: a, i: 0}, {o: 'M', b: a + 3, e: l + 3, q: a, i: 0}]
  ELSE [{o: 'M', b: 0, e: a, q: 0, i: 0}, {o: 'N', b: a, e: a + 5, q: a, i: 0}, {o: 'M', b: a + 5, e: l + 5, q: a, i: 0}] END) AS x FROM records),
cells AS (SELECT ord, qid, qname, flag, mapq, rname, kind, seq, qual, x.o AS o, x.i AS i, cast(pos + k AS int) AS p, k, x.e AS xe, CASE WHEN x.o = 'M' THEN x.q + k - x.b ELSE x.q END AS qp,
  l + CASE kind WHEN 2 THEN 3 WHEN 4 THEN 5 ELSE 0 END AS refs FROM (SELECT *, unnest(generate_series(x.b, x.e - 1)) AS k FROM blocks))"""

_FIELDS = "ord, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, rg, nm"


def _flat(r: DataFrame) -> DataFrame:
    return r.select("qname", "flag", "rname", "pos", "mapq", R.format_cigar("cigar").alias("cigar"), "rnext", "pnext", "tlen", "seq", "qual", R.tag("tags", "RG").alias("rg"), R.tag("tags", "NM").alias("nm"))


_ROUND = f"SELECT {_FIELDS.replace('ord, ', '')} FROM records"


@query(_ROUND, P.READS, RECORDS)
def sam_roundtrip(spark, d):
    path = shared_path(spark, "reads.sam")
    store.write_text(text.format_sam(whole_reads(spark, d)), path)
    return _flat(store.open_reads(spark, path))


@query("SELECT qname, flag, pos, seq FROM records", P.READS, RECORDS)
def sam_hex_flags(spark, d):
    path = shared_path(spark, "reads.sam")
    store.write_text(text.format_sam(whole_reads(spark, d), "hex"), path)
    return store.open_reads(spark, path).select("qname", "flag", "pos", "seq")


@query("SELECT qname, flag, pos, seq FROM records", P.READS, RECORDS)
def sam_char_flags(spark, d):
    path = shared_path(spark, "reads.sam")
    store.write_text(text.format_sam(whole_reads(spark, d), "char"), path)
    return store.open_reads(spark, path).select("qname", "flag", "pos", "seq")


@query(_ROUND, P.READS, RECORDS)
def bam_roundtrip(spark, d):
    """Files written by all tasks, each read in ranges, of 128 kB where the files are small."""
    folder = shared_path(spark, "bam")
    binary.write(whole_reads(spark, d), folder, CONTIGS)
    return _flat(store.open_reads(spark, folder, "bam", split_bytes=blocks.split_size(spark, folder, ".bam")))


def _sorted_bam(spark: SparkSession, d: str) -> str:
    """Folder of files in order of (rname, pos), a range each."""
    folder = shared_path(spark, "sorted-bam")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    binary.write(whole_reads(spark, d).repartitionByRange(parts, "rname", "pos").sortWithinPartitions("rname", "pos"), folder, CONTIGS)
    return folder


_STOP = "cast(pos + l + CASE kind WHEN 2 THEN 3 WHEN 4 THEN 5 ELSE 0 END AS int)"


@query(f"SELECT rid, qname, flag, pos, cigar, {_STOP} AS stop FROM records r JOIN regions g ON rname = 'chr' || g.tid AND pos < g.e + 1200 AND {_STOP} > g.b + 1200 WHERE rid % 50 = 0", P.READS, P.REGIONS, RECORDS)
def region_fetch_indexed(spark, d):
    """Every fiftieth region asks an index of block-compressed files; only chunks that some region needs are opened."""
    folder = _sorted_bam(spark, d)
    index = read_index.index_reads(spark, folder, folder + "-index", blocks.split_size(spark, folder, ".bam"))
    g = P.regions(spark, d).where("rid % 50 = 0").selectExpr("rid", "concat('chr', tid) AS rname", "b + 1200 AS b", "e + 1200 AS e")
    return read_index.fetch(index, g, cigar=R.format_cigar("cigar")).select("rid", "qname", "flag", "pos", "cigar", "stop")


@query(f"SELECT qname, flag, pos, mapq, {_STOP} AS stop FROM records WHERE rname = 'chr3' AND pos < 1250 AND {_STOP} > 1200", P.READS, RECORDS)
def region_scan_pushed(spark, d):
    """One region as a filter that the source gets, and answers from its index."""
    folder = _sorted_bam(spark, d)
    read_index.index_reads(spark, folder, folder + "-index", blocks.split_size(spark, folder, ".bam"))
    reads = store.open_reads(spark, folder, "bam", index=folder + "-index")
    return reads.where("rname = 'chr3' AND pos < 1250 AND stop > 1200").select("qname", "flag", "pos", "mapq", "stop")


@query("SELECT rname, bin, count(*) AS n FROM (SELECT rname, CASE WHEN (b >> 14) = (e - 1) >> 14 THEN 4681 + (b >> 14) ELSE 585 + (b >> 17) END AS bin FROM (SELECT rname, pos AS b, " + _STOP + " AS e FROM records)) GROUP BY ALL", P.READS, RECORDS)
def index_bins(spark, d):
    """Records by bin of the index, counted by reading all of its chunks."""
    folder = _sorted_bam(spark, d)
    index = read_index.index_reads(spark, folder, folder + "-index", blocks.split_size(spark, folder, ".bam"))
    r = read_index.read_chunks(index.where("kind = 'chunk'"))
    return r.groupBy("rname", R.bin_of("pos", "stop").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT '@' || qname || CASE WHEN flag & 64 <> 0 THEN '/1' WHEN flag & 128 <> 0 THEN '/2' ELSE '' END || chr(10) || CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END || chr(10) || '+' || chr(10) || CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS value FROM records",
    P.READS, RECORDS,
)
def reads_to_fastq(spark, d):
    return text.to_fastq(whole_reads(spark, d))


@query("SELECT rname AS chrom, pos AS beg, cast(pos + l + CASE kind WHEN 2 THEN 3 WHEN 4 THEN 5 ELSE 0 END AS int) AS \"end\", qname AS name, mapq AS score, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM records WHERE flag & 4 = 0", P.READS, RECORDS)
def reads_to_bed(spark, d):
    return text.to_bed(whole_reads(spark, d))


@query(
    "SELECT ord, cast(pos + l + CASE kind WHEN 2 THEN 3 WHEN 4 THEN 5 ELSE 0 END AS int) AS stop, n AS query, cast(l + CASE kind WHEN 1 THEN 2 ELSE 0 END AS int) AS aligned FROM records", P.READS, RECORDS,
)
def read_spans(spark, d):
    r = whole_reads(spark, d)
    return r.select("ord", R.reference_end("pos", "cigar").alias("stop"), R.query_length("cigar").alias("query"), R.aligned_and_inserted("cigar").alias("aligned"))


@query(
    f"""SELECT rname, p, count(*) AS n, count(*) FILTER (WHERE o IN ('D', 'N')) AS gone, count(*) FILTER (WHERE o = 'N') AS skips, count(*) FILTER (WHERE k = 0) AS heads, count(*) FILTER (WHERE k = refs - 1) AS tails,
cast(sum(CASE WHEN o = 'M' AND k = xe - 1 THEN i ELSE 0 END) AS bigint) AS indel, cast(sum(qp) AS bigint) AS qpos, cast(sum(ascii(substr(qual, qp + 1, 1)) - 33) AS bigint) AS baseq,
count(*) FILTER (WHERE o = 'M' AND substr(seq, qp + 1, 1) = 'A') AS a FROM cells WHERE flag & {PILEUP_SKIP} = 0 GROUP BY rname, p""",
    P.READS, RECORDS, BLOCKS,
)
def cigar_pileup(spark, d):
    p = tiles.position_sums(whole_reads(spark, d))
    return p.select("rname", "p", "n", "gone", "skips", "heads", "tails", "indel", "qpos", "baseq", "a")


#: Winners of positions and insertions, by the rules of a fold in arrival order.
_WINNERS = f"""here AS (SELECT rname, p AS pos, ord, mapq, CASE WHEN o = 'D' THEN '-' ELSE substr(seq, qp + 1, 1) END AS base FROM cells WHERE o <> 'N' AND flag & {CONSENSUS_SKIP} = 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY rname, pos ORDER BY ord) AS k FROM here),
base AS (SELECT rname, pos, base, mapq FROM (SELECT *, row_number() OVER (PARTITION BY rname, pos ORDER BY CASE WHEN k = 1 AND mapq = 255 THEN 0 WHEN mapq <> 255 THEN 1 ELSE 2 END, mapq DESC, ord) AS j FROM firsts) WHERE j = 1),
ins AS (SELECT rname, pos, ins, mapq FROM (SELECT rname, cast(pos + a AS int) AS pos, substr(seq, a + 1, 2) AS ins, mapq, row_number() OVER (PARTITION BY rname, pos + a ORDER BY mapq DESC, ord) AS j FROM records WHERE kind = 1 AND flag & {CONSENSUS_SKIP} = 0) WHERE j = 1)"""


@query("SELECT * FROM base", P.READS, RECORDS, BLOCKS, _WINNERS)
def cigar_consensus(spark, d):
    return consensus.winner(consensus.bases_and_insertions(whole_reads(spark, d))[0], ("rname", "pos"))


@query("SELECT * FROM ins", P.READS, RECORDS, BLOCKS, _WINNERS)
def cigar_insertions(spark, d):
    return consensus.insertion_winner(consensus.bases_and_insertions(whole_reads(spark, d))[1], ("rname", "pos"))


def reference(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("chr"), "id").alias("name"), F.repeat(F.lit(REFERENCE), F.lit(LENGTH // len(REFERENCE))).alias("seq"))


_REF = f"reference AS (SELECT 'chr' || i AS name, repeat('{REFERENCE}', {LENGTH // len(REFERENCE)}) AS seq FROM range(5) t(i))"


@query(
    """SELECT name AS rname, string_agg(repeat('-', length(coalesce(ins, ''))) || substr(seq, k + 1, 1), '' ORDER BY k) AS ref_aln, string_agg(coalesce(ins, '') || coalesce(base, 'N'), '' ORDER BY k) AS seq_aln
FROM (SELECT name, seq, cast(unnest(generate_series(0, length(seq) - 1)) AS int) AS k FROM reference) LEFT JOIN base ON base.rname = name AND base.pos = k LEFT JOIN ins ON ins.rname = name AND ins.pos = k GROUP BY name""",
    P.READS, RECORDS, BLOCKS, _WINNERS, _REF,
)
def consensus_alignment(spark, d):
    return consensus.pairwise(whole_reads(spark, d), reference(spark))


_MD = f"""letters AS (SELECT ord, p, o, substr('{REFERENCE}', p % {len(REFERENCE)} + 1, 1) AS r, o = 'D' AS gone, o = 'M' AND substr(seq, qp + 1, 1) <> r AS off, gone AND k = l // 2 AS opens FROM (SELECT *, refs - CASE kind WHEN 2 THEN 3 ELSE 0 END AS l FROM cells) WHERE o <> 'N'),
parts AS (SELECT *, sum(CASE WHEN off OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY p) AS g FROM letters),
pieces AS (SELECT ord, g, CASE WHEN bool_or(gone) THEN '^' ELSE '' END || coalesce(string_agg(r, '' ORDER BY p) FILTER (WHERE off OR gone), '') AS t, count(*) FILTER (WHERE NOT off AND NOT gone) AS same FROM parts GROUP BY ord, g),
starts AS (SELECT ord, g, t, same FROM pieces UNION ALL SELECT ord, 0, '', 0 FROM pieces GROUP BY ord HAVING min(g) > 0),
written AS (SELECT ord, string_agg(t || same, '' ORDER BY g) AS md FROM starts GROUP BY ord)"""


@query(
    f"""SELECT cells.ord, any_value(md) AS md, cast(count(*) FILTER (WHERE o = 'M' AND substr(seq, qp + 1, 1) <> substr('{REFERENCE}', p % {len(REFERENCE)} + 1, 1)) + max(CASE kind WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END) AS int) AS nm
FROM cells JOIN written USING (ord) GROUP BY cells.ord""",
    P.READS, RECORDS, BLOCKS, _MD,
)
def calmd(spark, d):
    return sites.calmd(whole_reads(spark, d), reference(spark)).select("ord", "md", "nm")


@query(
    f"""SELECT rname, p, count(*) FILTER (WHERE o = 'M' AND ascii(substr(qual, qp + 1, 1)) - 33 >= 13) AS depth FROM cells c WHERE flag & {PILEUP_SKIP} = 0 AND mapq >= 20
AND EXISTS (SELECT 1 FROM regions g WHERE 'chr' || g.tid = c.rname AND g.b + 1200 <= c.p AND c.p < g.e + 1200) GROUP BY rname, p""",
    P.READS, P.REGIONS, RECORDS, BLOCKS,
)
def base_depth(spark, d):
    g = P.regions(spark, d).selectExpr("concat('chr', tid) AS rname", "b + 1200 AS b", "e + 1200 AS e")
    return depth.base_depth(depth.pileup_cigar(whole_reads(spark, d)), 13, 20, g)


_TEXT = f"""shown AS (SELECT rname, p, ord, qid % 2 AS file, substr('{REFERENCE}', p % {len(REFERENCE)} + 1, 1) AS ref, CASE WHEN k = 0 THEN '^' || chr(mapq + 33) ELSE '' END
  || CASE WHEN o = 'N' THEN CASE WHEN rev THEN '<' ELSE '>' END WHEN o = 'D' THEN '*' WHEN substr(seq, qp + 1, 1) = substr('{REFERENCE}', p % {len(REFERENCE)} + 1, 1) THEN CASE WHEN rev THEN ',' ELSE '.' END
     WHEN rev THEN lower(substr(seq, qp + 1, 1)) ELSE substr(seq, qp + 1, 1) END
  || CASE WHEN o = 'M' AND k = xe - 1 AND i = 2 THEN '+2' || CASE WHEN rev THEN lower(substr(seq, qp + 2, 2)) ELSE substr(seq, qp + 2, 2) END
          WHEN o = 'M' AND k = xe - 1 AND i = -3 THEN '-3' || CASE WHEN rev THEN lower(substr(repeat('{REFERENCE}', 2), (p + 1) % {len(REFERENCE)} + 1, 3)) ELSE substr(repeat('{REFERENCE}', 2), (p + 1) % {len(REFERENCE)} + 1, 3) END ELSE '' END
  || CASE WHEN k = refs - 1 THEN '$' ELSE '' END AS b, substr(qual, qp + 1, 1) AS q FROM (SELECT *, flag & 16 <> 0 AS rev FROM cells WHERE flag & {PILEUP_SKIP} = 0 AND ascii(substr(qual, qp + 1, 1)) - 33 >= 13))"""


@query(
    "SELECT rname, p, ref, " + ", ".join(f"cast(count(*) FILTER (WHERE file = {k}) AS int) AS n{k}, coalesce(string_agg(b, '' ORDER BY ord) FILTER (WHERE file = {k}), '*') AS bases{k}, coalesce(string_agg(q, '' ORDER BY ord) FILTER (WHERE file = {k}), '*') AS quals{k}" for k in (0, 1)) + " FROM shown GROUP BY rname, p, ref",
    P.READS, RECORDS, BLOCKS, _TEXT,
)
def mpileup_files(spark, d):
    r = whole_reads(spark, d).withColumn("file", F.col("qid") % 2)
    return tiles.mpileup(r, reference(spark), [0, 1], ahead=depth.longest_deletion(r))


@query(
    f""", base AS (SELECT ord, max(mapq) AS mapq, max(kind) AS kind, max(n) AS n, max(qual) AS qual, count(*) FILTER (WHERE o = 'M') + count(*) FILTER (WHERE o = 'M' AND q >= 13) AS len, count(*) FILTER (WHERE bad) AS mism, coalesce(sum(least(q, 33)) FILTER (WHERE bad), 0) AS total
  FROM (SELECT *, q >= 13 AND o = 'M' AND substr(seq, qp + 1, 1) <> substr('{REFERENCE}', p % {len(REFERENCE)} + 1, 1) AS bad FROM (SELECT c.*, s.n, ascii(substr(c.qual, qp + 1, 1)) - 33 AS q FROM cells c JOIN (SELECT ord, n FROM records) s USING (ord))) GROUP BY ord),
cost AS (SELECT *, total - 4.343 * (lgamma(len + 1) - lgamma(mism + 1) - lgamma(len - mism + 1)) + CASE WHEN kind = 3 THEN ascii(substr(qual, 1, 1)) + ascii(substr(qual, 2, 1)) + ascii(substr(qual, n, 1)) - 99 ELSE 0 END / 5.0 AS t FROM base)
SELECT ord, cast(least(mapq, trunc(sqrt((50 - greatest(t, 0)) / 50) * 50 + 0.499)) AS int) AS mapq FROM cost WHERE t <= 50""",
    P.READS, RECORDS, BLOCKS,
)
def capped_mapq(spark, d):
    return sites.cap_mapq(whole_reads(spark, d), reference(spark))


@query("SELECT 'chr' || (rid % 6) AS name, b AS beg, e * 2 AS \"end\", coalesce(substr(seq, greatest(b, 0) + 1, greatest(least(e * 2, length(seq)) - greatest(b, 0), 0)), '') AS seq FROM regions JOIN reference ON name = 'chr' || (rid % 6)", P.REGIONS, _REF)
def fetch_sequences(spark, d):
    g = P.regions(spark, d).select(F.concat(F.lit("chr"), F.col("rid") % 6).alias("name"), F.col("b").alias("beg"), (F.col("e") * 2).alias("end"))
    return sites.fetch_sequence(reference(spark), g)


@query("SELECT ord FROM records WHERE rg IS NULL OR rg = 'g1'", P.READS, RECORDS)
def read_group_filter(spark, d):
    return records.view(whole_reads(spark, d).withColumn("rg", R.tag("tags", "RG")), read_groups=["g1"]).select("ord")


@query("SELECT ord FROM records WHERE rg IN ('g0', 'g2') AND mapq >= 5", P.READS, RECORDS)
def library_filter(spark, d):
    header = spark.createDataFrame([("g0", "lib1", "s0"), ("g1", "lib2", "s1"), ("g2", "lib1", "s2")], "rg string, lb string, sm string")
    return records.view(whole_reads(spark, d).withColumn("rg", R.tag("tags", "RG")), 5, libraries=["lib1"], header=header).select("ord")


@query("SELECT ord, rg, CASE rg WHEN 'g0' THEN 'lib1' WHEN 'g1' THEN 'lib2' WHEN 'g2' THEN 'lib1' END AS lb, CASE WHEN rg IS NOT NULL THEN 's' || right(rg, 1) END AS sm FROM records", P.READS, RECORDS)
def read_samples(spark, d):
    header = spark.createDataFrame([("g0", "lib1", "s0"), ("g1", "lib2", "s1"), ("g2", "lib1", "s2")], "rg string, lb string, sm string")
    return headers.with_sample(whole_reads(spark, d), header).select("ord", "rg", "lb", "sm")


_Q = "list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)"


@query(f"SELECT ord, array_to_string(list_transform({_Q}, lambda q: least(cast(floor(q * 0.5) AS int), 93)), ',') AS quals FROM records", P.READS, RECORDS)
def scaled_qualities(spark, d):
    return whole_reads(spark, d).select("ord", F.array_join(R.scale_quality(_quals(), 0.5).cast("array<string>"), ",").alias("quals"))


def _quals():
    return F.transform(F.filter(F.split("qual", ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)


@query(
    f""", steps AS (SELECT ord, n, i, sum(20 - q) OVER (PARTITION BY ord ORDER BY i) AS s FROM (SELECT ord, n, unnest(list_reverse({_Q})) AS q, unnest(generate_series(1, n)) AS i FROM records WHERE n > 10)),
ends AS (SELECT ord, coalesce(min(i) FILTER (WHERE s < 0 OR i >= n - 10 + 1), 1000) AS stop FROM steps GROUP BY ord)
SELECT records.ord, cast(coalesce(most, 0) AS int) AS cut FROM records LEFT JOIN (SELECT ord, arg_min(i, {{'s': -s, 'i': i}}) AS most FROM steps JOIN ends USING (ord) WHERE i < stop AND s > 0 GROUP BY ord) USING (ord)""",
    P.READS, RECORDS,
)
def trimmed_lengths(spark, d):
    return whole_reads(spark, d).select("ord", R.trim_length(_quals(), 20, 10).cast("int").alias("cut"))


@query(
    """SELECT count(*) AS sequences, cast(sum(n) AS bigint) AS bases, max(n) AS longest, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 4 <> 0) AS unmapped,
count(*) FILTER (WHERE flag & 4 = 0 AND mapq = 0) AS mapq0, count(*) FILTER (WHERE flag & 1 <> 0) AS paired, count(*) FILTER (WHERE flag & 1024 <> 0) AS duplicates,
cast(sum(l + CASE kind WHEN 1 THEN 2 ELSE 0 END) FILTER (WHERE flag & 4 = 0) AS bigint) AS bases_mapped_cigar, round(avg(n), 6) AS mean_length FROM records""",
    P.READS, RECORDS,
)
def stats_summary(spark, d):
    return quality.summary(whole_reads(spark, d))


@query(
    "SELECT CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS read, cast(c - 1 AS int) AS cycle, ascii(substr(CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END, cast(c AS int), 1)) - 33 AS qual, count(*) AS n FROM (SELECT *, unnest(generate_series(1, n)) AS c FROM records) GROUP BY ALL",
    P.READS, RECORDS,
)
def stats_quality_by_cycle(spark, d):
    return quality.quality_by_cycle(whole_reads(spark, d))


@query("SELECT cast(floor((length(seq) - length(translate(seq, 'GC', ''))) * 100 / n) AS int) AS gc, count(*) AS n FROM records GROUP BY 1", P.READS, RECORDS)
def stats_gc(spark, d):
    return quality.gc_histogram(whole_reads(spark, d))


@query(
    "SELECT cast(c - 1 AS int) AS cycle, substr(CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, cast(c AS int), 1) AS base, count(*) AS n FROM (SELECT *, unnest(generate_series(1, n)) AS c FROM records) GROUP BY ALL",
    P.READS, RECORDS,
)
def stats_base_by_cycle(spark, d):
    return quality.base_by_cycle(whole_reads(spark, d))


@query(
    f"""SELECT cast(CASE WHEN flag & 16 <> 0 THEN length(seq) - 1 - qp ELSE qp END AS int) AS cycle, cast(ascii(substr(qual, qp + 1, 1)) - 33 AS int) AS qual, count(*) AS n
FROM cells WHERE o = 'M' AND flag & 4 = 0 AND substr(seq, qp + 1, 1) <> substr('{REFERENCE}', p % {len(REFERENCE)} + 1, 1) GROUP BY ALL""",
    P.READS, RECORDS, BLOCKS,
)
def stats_mismatches_by_cycle(spark, d):
    return cycle_statistics.mismatches_by_cycle(whole_reads(spark, d), reference(spark))


@query(
    """SELECT cast(CASE WHEN kind = 1 THEN CASE WHEN flag & 16 <> 0 THEN n - a - 2 ELSE a END ELSE CASE WHEN flag & 16 <> 0 THEN n - a - 1 ELSE a - 1 END END AS int) AS cycle, CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS read,
count(*) FILTER (WHERE kind = 1) AS insertions, count(*) FILTER (WHERE kind = 2) AS deletions FROM records WHERE kind IN (1, 2) AND flag & 4 = 0 GROUP BY ALL""",
    P.READS, RECORDS,
)
def stats_gaps_by_cycle(spark, d):
    return cycle_statistics.gaps_by_cycle(whole_reads(spark, d), reference(spark))


@query(
    """, w AS (SELECT rname, pos // 10 AS w, sum(length(seq) - length(translate(seq, 'GC', ''))) AS gc, sum(n) AS n FROM records WHERE flag & 4 = 0 GROUP BY ALL)
SELECT cast(floor(100 * gc / n) AS int) AS gc, count(*) AS windows, """
    + ", ".join(f"round(quantile_cont(n / 10.0::DOUBLE, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))
    + " FROM w GROUP BY 1",
    P.READS, RECORDS,
)
def stats_gc_depth(spark, d):
    return cycle_statistics.gc_depth(whole_reads(spark, d), 10)


@query("SELECT n AS len, count(*) AS n FROM records GROUP BY 1", P.READS, RECORDS)
def stats_read_lengths(spark, d):
    return quality.read_lengths(whole_reads(spark, d))


@query("SELECT CASE kind WHEN 1 THEN 2 ELSE 3 END AS len, count(*) FILTER (WHERE kind = 1) AS insertions, count(*) FILTER (WHERE kind = 2) AS deletions FROM records WHERE kind IN (1, 2) AND flag & 4 = 0 GROUP BY 1", P.READS, RECORDS)
def stats_indel_lengths(spark, d):
    return quality.indel_lengths(whole_reads(spark, d))


@query("SELECT 'g' || (qid % 3) AS rg, cast(mapq % 9 AS int) AS run, count(*) FILTER (WHERE qid % 4 = 3) AS ins, count(*) FILTER (WHERE qid % 4 = 1) AS del FROM reads WHERE qid % 2 = 1 GROUP BY 1, 2", P.READS)
def homopolymer_indels(spark, d):
    r = P.reads(spark, d).selectExpr("concat('g', qid % 3) AS rg", "CAST(qid % 4 - 2 AS int) AS len", "CAST(mapq % 9 AS int) AS run")
    return quality.indels_by_homopolymer(r)


@query("SELECT 'chr' || tid AS chrom, b AS beg, e AS \"end\" FROM regions", P.REGIONS)
def bed_roundtrip(spark, d):
    path = shared_path(spark, "regions.bed")
    store.write_text(P.regions(spark, d).select(F.concat_ws("\t", F.concat(F.lit("chr"), "tid"), "b", "e", F.concat(F.lit("r"), "rid")).alias("value")), path)
    return text.read_bed(spark, path)


@query("SELECT 's' || seq AS name, '' AS description, seqs AS seq FROM sequences WHERE length(seqs) > 0", P.SEQUENCES)
def fasta_roundtrip(spark, d):
    path = shared_path(spark, "sequences.fa")
    named = P.sequences(spark, d).where("length(seqs) > 0").select(F.concat(F.lit("s"), "seq").alias("name"), F.col("seqs").alias("seq"))
    store.write_text(text.format_fasta(named), path)
    return text.read_fasta(spark, path, strict=True)


@query("SELECT seq, lower(seqs) AS value FROM sequences", P.SEQUENCES)
def plain_sequences(spark, d):
    s = P.sequences(spark, d)
    return s.select("seq", text.plain_column("seqs").alias("value"))


@query("SELECT rid, 'chr' || tid AS chrom, greatest(b + 3000 - 1, 0) AS beg, CASE WHEN rid % 3 = 0 THEN 536870912 ELSE e + 3000 END AS \"end\" FROM regions", P.REGIONS)
def parse_regions(spark, d):
    g = P.regions(spark, d)
    shown = F.concat(F.lit("chr"), "tid", F.lit(":"), F.format_number(F.col("b") + 3000, 0), F.when(F.col("rid") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.format_number(F.col("e") + 3000, 0))))
    return g.select("rid", R.parse_region(shown).alias("x")).select("rid", "x.*")


_BINS = " UNION ALL ".join(["SELECT rid, 0 AS bin FROM spans"] + [f"SELECT rid, {((1 << (29 - s)) - 1) // 7} + unnest(generate_series(lo >> {s}, hi >> {s})) AS bin FROM spans" for s in (26, 23, 20, 17, 14)])


@query(f", spans AS (SELECT rid, (b + 1200) * 40 AS lo, (e + 1200) * 40 - 1 AS hi FROM regions) SELECT rid, cast(bin AS int) AS bin FROM ({_BINS})", P.REGIONS)
def region_bins(spark, d):
    g = P.regions(spark, d)
    return g.select("rid", F.explode(R.bins_over((F.col("b") + 1200) * 40, (F.col("e") + 1200) * 40)).alias("bin"))


def site_lines(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood sites as site lines: SNPs, insertions, an unseen allele, two alternatives; 22 samples."""
    s = P.likelihoods(spark, d).selectExpr("site", "pl", "substring('ACGT', CAST(site % 4 + 1 AS int), 1) AS r", "substring('ACGT', CAST((site + 1) % 4 + 1 AS int), 1) AS b", "substring('ACGT', CAST((site + 2) % 4 + 1 AS int), 1) AS c")
    one = "map('GT', element_at(array('0/0', '0/1', '1/1', './.'), CASE WHEN array_max(x) = 0 THEN 4 ELSE CAST(array_position(x, array_min(x)) AS int) END), 'DP', CAST(x[0] % 20 AS string), 'GQ', CAST(array_max(x) AS string), 'SP', CAST(x[1] % 30 AS string))"
    return s.selectExpr(
        "concat('chr', site % 3) AS chrom", "CAST(site * 5 AS int) AS pos", "concat('rs', site) AS id", "r AS ref", "CASE site % 6 WHEN 0 THEN array(concat(r, 'A')) WHEN 1 THEN array('X') WHEN 2 THEN array(b, c) ELSE array(b) END AS alt",
        "CAST(site % 100 + 0.5 AS double) AS qual", "'PASS' AS filter", "map('DP', CAST(site % 40 AS string), 'MQ', CAST(site % 60 AS string)) AS info", f"transform(pl, x -> {one}) AS samples",
    )


SAMPLES = [f"s{k}" for k in range(22)]
SITE_LINES = """lines AS (SELECT site, 'chr' || (site % 3) AS chrom, cast(site * 5 AS int) AS pos, 'rs' || site AS id, r AS ref, CASE site % 6 WHEN 0 THEN [r || 'A'] WHEN 1 THEN ['X'] WHEN 2 THEN [b, c] ELSE [b] END AS alt,
  cast(site % 100 + 0.5 AS double) AS qual, cast(site % 40 AS int) AS dp, cast(site % 60 AS int) AS mq,
  list_transform(pl, lambda x: CASE WHEN list_max(x) = 0 THEN './.' ELSE ['0/0', '0/1', '1/1'][list_position(x, list_min(x))] END) AS gt, list_transform(pl, lambda x: x[1] % 20) AS sdp, list_transform(pl, lambda x: list_max(x)) AS gq, list_transform(pl, lambda x: x[2] % 30) AS sp
  FROM (SELECT *, substr('ACGT', cast(site % 4 + 1 AS int), 1) AS r, substr('ACGT', cast((site + 1) % 4 + 1 AS int), 1) AS b, substr('ACGT', cast((site + 2) % 4 + 1 AS int), 1) AS c FROM sites))"""

from .queries import _PL as SITES  # noqa: E402

_LINE = "chrom, pos, id, ref, array_to_string(alt, ',') AS alt, qual, 'PASS' AS filter, cast(dp AS varchar) AS dp, cast(mq AS varchar) AS mq, array_to_string(gt, ' ') AS gt, array_to_string(sdp, ' ') AS sdp, array_to_string(gq, ' ') AS gq"


def _site_header(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("##fileformat=VCFv4.1",), ("\t".join(["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT", *SAMPLES]),)], "value string")


def _shown(v: DataFrame, *more: str) -> DataFrame:
    each = lambda k: F.array_join(F.transform("samples", lambda s: s[k]), " ")
    return v.select(*more, "chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), "qual", "filter", F.col("info")["DP"].alias("dp"), F.col("info")["MQ"].alias("mq"), each("GT").alias("gt"), each("DP").alias("sdp"), each("GQ").alias("gq"))


@query(f"SELECT {_LINE} FROM lines", SITES, SITE_LINES)
def vcf_roundtrip(spark, d):
    path = shared_path(spark, "sites.vcf")
    head = _site_header(spark)
    store.write_text(text.format_vcf(site_lines(spark, d)), path, head)
    return _shown(store.open_sites(spark, path))


@query(f"SELECT {_LINE} FROM lines", SITES, SITE_LINES)
def bcf_roundtrip(spark, d):
    """Binary site files written by all tasks and read again."""
    folder = shared_path(spark, "bcf")
    sites_binary.write(site_lines(spark, d), folder, ["chr0", "chr1", "chr2"], SAMPLES)
    return _shown(store.open_sites(spark, folder, "bcf"))


@query(f"SELECT cast(site % 2 AS int) AS file, {_LINE} FROM lines", SITES, SITE_LINES)
def bcf_cat(spark, d):
    """Two folders of binary site files, one after the other."""
    v, paths = site_lines(spark, d), []
    for k in (0, 1):
        paths.append(shared_path(spark, f"bcf{k}"))
        sites_binary.write(v.where(F.substring("id", 3, 20).cast("long") % 2 == k), paths[-1], ["chr0", "chr1", "chr2"], SAMPLES)
    return _shown(store.concatenate_sites(spark, paths, "bcf"), "file")


@query("SELECT chrom, pos FROM lines WHERE alt <> ['X'] AND len(list_filter(sdp, lambda x: x > 0)) >= 0.3 * 22 AND NOT (length(alt[1]) <> 1)", SITES, SITE_LINES)
def vcf_site_filter(spark, d):
    return sites.site_filter(site_lines(spark, d), 0.3, "skip", True).select("chrom", "pos")


@query("SELECT chrom, pos, gt[3] || ' ' || gt[22] || ' ' || gt[1] AS gt FROM lines", SITES, SITE_LINES)
def vcf_subset(spark, d):
    v = sites.subset_samples(site_lines(spark, d), SAMPLES, ["s2", "s21", "s0"])
    return v.select("chrom", "pos", F.array_join(F.transform("samples", lambda s: s["GT"]), " ").alias("gt"))


@query("SELECT cast(length(a) - length(ref) AS int) AS len, round(sum(1.0 / len(alt)), 6)::DOUBLE AS weight FROM (SELECT ref, alt, unnest(alt) AS a FROM lines) WHERE length(a) <> length(ref) GROUP BY 1", SITES, SITE_LINES)
def vcf_gap_lengths(spark, d):
    return sites.gap_stats(site_lines(spark, d))


@query(
    """SELECT chrom, pos, array_to_string(list_transform(generate_series(1, len(alt)), lambda k: cast(len(list_filter(called, lambda x: x = cast(k AS varchar))) AS varchar)), ',') AS ac, cast(len(called) AS varchar) AS an
FROM (SELECT *, list_filter(flatten(list_transform(gt, lambda g: string_split(g, '/'))), lambda x: x <> '.') AS called FROM lines)""",
    SITES, SITE_LINES,
)
def vcf_fill_counts(spark, d):
    v = sites.fill_counts(site_lines(spark, d))
    return v.select("chrom", "pos", F.col("info")["AC"].alias("ac"), F.col("info")["AN"].alias("an"))


@query("SELECT chrom, pos, cast(list_max(sp) AS int) AS mxsp, cast(list_max(gq) AS int) AS mxgq FROM lines", SITES, SITE_LINES)
def vcf_sample_maxima(spark, d):
    return sites.sample_maxima(site_lines(spark, d))


@query(
    "SELECT l.chrom, l.pos, t.site IS NOT NULL AS known, coalesce(list_has_any(l.alt, t.alt), false) AS same_allele FROM lines l LEFT JOIN (SELECT site, chrom, pos, CASE WHEN site % 4 = 0 THEN ['N'] ELSE alt END AS alt FROM lines WHERE site % 2 = 0) t ON l.chrom = t.chrom AND l.pos = t.pos",
    SITES, SITE_LINES,
)
def vcf_truth(spark, d):
    v = site_lines(spark, d).withColumn("site", F.expr("CAST(substring(id, 3) AS long)"))
    truth = v.where("site % 2 = 0").withColumn("alt", F.when(F.col("site") % 4 == 0, F.array(F.lit("N"))).otherwise(F.col("alt")))
    return sites.truth_lookup(v, truth)


@query("SELECT id AS rs, chrom, pos, ref, CASE WHEN site % 2 = 1 THEN translate(ref || alt[1], 'ACGT', 'TGCA') ELSE ref || alt[1] END AS alleles FROM lines WHERE site % 3 <> 0", SITES, SITE_LINES)
def markers_oriented(spark, d):
    v = site_lines(spark, d).withColumn("site", F.expr("CAST(substring(id, 3) AS long)"))
    catalogue = v.where("site % 3 <> 0").select(F.col("id").alias("rs"), "chrom", "pos", F.when(F.col("site") % 2 == 1, "-").otherwise("+").alias("strand"), "ref")
    return sites.oriented(v.select(F.col("id").alias("rs"), F.concat("ref", F.col("alt")[0]).alias("alleles")), catalogue)


@query(
    """SELECT chrom, pos, CASE WHEN dp < 3 OR mq < 10 THEN lower(letter) ELSE letter END AS letter FROM (
SELECT *, CASE WHEN x = y THEN x ELSE coalesce(map {'AC': 'M', 'AG': 'R', 'AT': 'W', 'CG': 'S', 'CT': 'Y', 'GT': 'K'}[least(x, y) || greatest(x, y)], 'N') END AS letter FROM (
SELECT *, CASE gt[1] WHEN '1/1' THEN alt[1] ELSE ref END AS x, CASE gt[1] WHEN '0/1' THEN alt[1] WHEN '1/1' THEN alt[1] ELSE ref END AS y FROM lines WHERE length(alt[1]) = 1))""",
    SITES, SITE_LINES,
)
def vcf_letters(spark, d):
    return sites.consensus_letters(site_lines(spark, d))


@query(
    """, indexed AS (SELECT seq, length(seqs) AS len, cast(ceil(length(seqs) / 60.0) AS bigint) AS breaks, 3 + length(cast(seq AS varchar)) AS head FROM sequences WHERE length(seqs) > 0)
SELECT 's' || seq || ' ' || len || ' ' || cast(sum(head + len + breaks) OVER (ORDER BY seq) - len - breaks AS bigint) || ' ' || least(len, 60) || ' ' || least(len, 60) + 1 AS place FROM indexed""",
    P.SEQUENCES,
)
def fasta_index(spark, d):
    """Files of all tasks in order of the sequences, indexed in ranges; offsets are those of the files one behind the other."""
    path = shared_path(spark, "indexed.fa")
    named = P.sequences(spark, d).where("length(seqs) > 0").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq").sortWithinPartitions("seq").select(F.concat(F.lit("s"), "seq").alias("name"), F.col("seqs").alias("seq"))
    store.write_text(text.format_fasta(named), path)
    x = sequence_index.sequence_index(spark, path, blocks.split_size(spark, path, ".txt", 64 << 10), ".txt")
    return sequence_index.as_one_file(x, path, ".txt").select(F.concat_ws(" ", "name", "len", "offset", "line_bases", "line_bytes").alias("place"))


@query("SELECT chrom, pos, lower(letter) AS letter FROM near UNION ALL SELECT chrom, pos, letter FROM letters WHERE (chrom, pos) NOT IN (SELECT (chrom, pos) FROM near)", SITES, SITE_LINES,
       "letters AS (SELECT chrom, pos, ref AS letter FROM lines WHERE length(alt[1]) = 1)", "near AS (SELECT DISTINCT l.chrom, l.pos, l.letter FROM letters l JOIN lines i ON i.chrom = l.chrom AND length(i.alt[1]) <> 1 AND abs(i.pos - l.pos) <= 15)")
def letters_near_indels(spark, d):
    v = site_lines(spark, d)
    snp = F.length(F.col("alt")[0]) == 1
    return sites.mask_near_indels(v.where(snp).select("chrom", "pos", F.col("ref").alias("letter")), v.where(~snp).select("chrom", "pos"), 15)


def header(spark: SparkSession, d: str, first: bool) -> DataFrame:
    """Header lines from tables: a contig for each nation, a read group for each region, and a comment; two headers that overlap."""
    nations, regions_ = P.table(spark, d, "nation"), P.table(spark, d, "region")
    own, groups = (F.col("n_nationkey") < 15, F.col("r_regionkey") < 3) if first else (F.col("n_nationkey") >= 10, F.col("r_regionkey") >= 2)
    s = lambda x: x.cast("string")
    line = lambda n, kind, *tags: (n.cast("long").alias("line_no"), F.lit(kind).alias("type"), F.create_map(*[F.lit(t) if isinstance(t, str) else t for t in tags]).alias("tags"))
    top = regions_.where("r_regionkey = 0").select(*line(F.lit(0), "HD", "VN", F.lit("1.4"), "SO", F.lit("unsorted")))
    sq = nations.where(own).select(*line(F.col("n_nationkey") + 1, "SQ", "SN", F.concat(F.lit("chr"), s(F.col("n_nationkey"))), "LN", s(F.lit(LENGTH + (not first)) + F.col("n_regionkey"))))
    rg = regions_.where(groups).select(*line(F.col("r_regionkey") + 100, "RG", "ID", F.concat(F.lit("g"), s(F.col("r_regionkey"))), "LB", F.lower("r_name"), "SM", F.lit("s")))
    return top.unionByName(sq).unionByName(rg).unionByName(regions_.where("r_regionkey = 0").select(*line(F.lit(200), "CO", "text", F.lit("from tables"))))


_HEADERS = f"""head AS (SELECT 0 AS line_no, 'HD' AS type, 'SO:unsorted VN:1.4' AS place, 'HD' AS name, 0 AS side UNION ALL SELECT 200, 'CO', 'text:from tables', 'CO', 0
UNION ALL SELECT n_nationkey + 1, 'SQ', 'LN:' || ({LENGTH} + n_regionkey + CASE WHEN n_nationkey < 15 THEN 0 ELSE 1 END) || ' SN:chr' || n_nationkey, 'chr' || n_nationkey, CASE WHEN n_nationkey < 15 THEN 0 ELSE 1 END FROM nation
UNION ALL SELECT r_regionkey + 100, 'RG', 'ID:g' || r_regionkey || ' LB:' || lower(r_name) || ' SM:s', 'g' || r_regionkey, CASE WHEN r_regionkey < 3 THEN 0 ELSE 1 END FROM region)"""


def _lines(h: DataFrame) -> DataFrame:
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")
    return h.select(F.col("line_no").cast("int").alias("line_no"), "type", tags.alias("place"))


@query("SELECT cast(line_no AS int) AS line_no, type, place FROM head", _HEADERS)
def headers_merged(spark, d):
    return _lines(headers.merge_headers(header(spark, d, True), header(spark, d, False)))


@query("SELECT cast(line_no AS int) AS line_no, type, replace(place, 'SO:unsorted', 'SO:coordinate') AS place FROM head WHERE side = 0 AND (type <> 'RG' OR name = 'g1')", _HEADERS)
def header_edited(spark, d):
    return _lines(headers.keep_read_groups(headers.set_sort_order(header(spark, d, True), "coordinate"), ["g1"]))


@query("SELECT cast(row_number() OVER (ORDER BY line_no) - 1 AS int) AS tid, name, regexp_extract(place, 'LN:(\\d+)', 1)::INT AS len FROM head WHERE type = 'SQ' AND side = 0", _HEADERS)
def header_contigs(spark, d):
    return headers.contig_table(header(spark, d, True))


@query("SELECT cast(count(*) FILTER (WHERE r2 > 0.5) AS bigint) AS n, cast(coalesce(sum(pos - prev) FILTER (WHERE r2 > 0.5), 0) AS bigint) AS span FROM (SELECT site * 5 AS pos, site * 5 - 5 AS prev, (site % 10) / 10.0 AS r2 FROM sites)", SITES)
def linkage_steps(spark, d):
    return sites.linkage_spans(P.likelihoods(spark, d).select((F.col("site") * 5).alias("pos"), (F.col("site") * 5 - 5).alias("prev"), ((F.col("site") % 10) / 10.0).alias("r2")))


@query("SELECT ord, array_to_string(list_filter(['p', 'P', 'u', 'U', 'r', 'R', '1', '2', 's', 'f', 'd'], lambda c, i: (flag >> (cast(i AS int) - 1)) & 1 = 1), '') AS shown FROM reads", P.READS)
def flag_strings(spark, d):
    return P.reads(spark, d).select("ord", R.flag_string("flag").alias("shown"))


@query("SELECT ord, array_to_string(list_sort(list_filter([CASE WHEN rg IS NOT NULL THEN 'RG:Z:' || rg END, 'XM:i:' || mapq], lambda x: x IS NOT NULL)), ' ') AS tags FROM records", P.READS, RECORDS)
def tags_edited(spark, d):
    r = whole_reads(spark, d)
    edited = R.drop_tag(R.set_tag("tags", "XM", "i", F.col("mapq")), "NM")
    return r.select("ord", F.array_join(F.transform(F.array_sort(F.map_entries(edited)), lambda t: F.concat_ws(":", t["key"], t["value"]["type"], t["value"]["value"])), " ").alias("tags"))


@query(
    f"""SELECT rname, p, count(*) AS depth, count(*) FILTER (WHERE gap) AS support, array_to_string(list_sort(list_distinct(list(CASE WHEN gap THEN i ELSE 0 END) || [0])), ',') AS sizes
FROM (SELECT *, o = 'M' AND k = xe - 1 AND i <> 0 AS gap FROM cells WHERE flag & {PILEUP_SKIP} = 0) GROUP BY rname, p HAVING count(*) FILTER (WHERE gap) >= 2 AND count(*) FILTER (WHERE gap) >= 0.05 * count(*)""",
    P.READS, RECORDS, BLOCKS,
)
def gap_candidates(spark, d):
    return gaps.gap_candidates(depth.pileup_cigar(whole_reads(spark, d)), 2, 0.05).withColumn("sizes", F.array_join("sizes", ","))


_MARKERS = """markers AS (SELECT 'chr' || o_custkey % 5 AS chrom, o_orderkey % 100000 + 1 AS start, 'rs' || o_orderkey AS name, o_orderkey % 2 = 1 AS back, ['A', 'C', 'G', 'T'][o_custkey % 4 + 1] AS ref,
  ['A/C', 'C/T', 'A/G/T', '-/AC', 'G/-'][o_orderkey % 5 + 1] AS observed, o_orderkey % 3 = 0 AS unknown FROM orders),
turned AS (SELECT *, CASE WHEN back THEN translate(reverse(observed), 'ACGT', 'TGCA') ELSE observed END AS seen, observed LIKE '%-%' AS gap FROM markers)"""


@query(
    """SELECT chrom, cast(start - gap::INT AS bigint) AS pos, name AS id, CASE WHEN gap THEN 'N' ELSE '' END || ref AS ref,
array_to_string(list_transform(list_filter(string_split(seen, '/'), lambda x: x <> ref), lambda x: CASE WHEN gap THEN 'N' || replace(x, '-', '') ELSE x END), ',') AS alt,
CASE WHEN unknown THEN 'molType=genomic;class=mixed' ELSE 'molType=genomic;class=mixed;valid=by-cluster' END AS info FROM turned""",
    _MARKERS,
)
def marker_sites(spark, d):
    """orders as a marker list with turned strands, single letters and gaps."""
    m = P.table(spark, d, "orders").selectExpr(
        "concat('chr', o_custkey % 5) AS chrom", "o_orderkey % 100000 + 1 AS start", "concat('rs', o_orderkey) AS name", "IF(o_orderkey % 2 = 1, '-', '+') AS strand", "array('A', 'C', 'G', 'T')[CAST(o_custkey % 4 AS int)] AS ref",
        "array('A/C', 'C/T', 'A/G/T', '-/AC', 'G/-')[CAST(o_orderkey % 5 AS int)] AS observed", "'genomic' AS molecule", "'mixed' AS class", "IF(o_orderkey % 3 = 0, 'unknown', 'by-cluster') AS valid", "0.0D AS frequency",
    )
    v = sites.marker_sites(m)
    return v.withColumns({"alt": F.array_join("alt", ","), "info": F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")})


#: Letters around each planted gap (the base before it first), sizes of gaps and what the insertions put in.
MOTIF, GAP_SIZES, PUT_IN = "TGACTCAG", (-1, -3, 1, 2, 5), {1: "A", 2: "CC", 5: "CATCA"}
_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_WINDOW = "translate(md5(concat_ws('|', {k}, 'a')), " + _HEX + "), substr(translate(md5(concat_ws('|', {k}, 'b')), " + _HEX + f"), 1, 28), '{MOTIF}', translate(md5(concat_ws('|', {{k}}, 'c')), " + _HEX + ")"


def planted_reference(spark: SparkSession, d: str) -> DataFrame:
    """A contig for each supplier: ten windows of 100 letters, a gap may stand after letter 60 of each."""
    w = F.expr(f"concat_ws('', transform(sequence(0, 9), i -> concat({_WINDOW.format(k='s_suppkey, i')})))")
    return P.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), w.alias("seq"))


def planted_gaps(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as reads of three samples over the windows of their supplier. Whether a sample has the window's gap on none, half or all of its
    reads, and which size, are known; a fourth of the reads with a gap were placed without it, so that only realignment finds it."""
    # making a read costs far more than a shuffle of its keys, and a table may be one file
    keys = P.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    r = keys.selectExpr("l_suppkey AS sup", "l_orderkey AS qid", "CAST(conv(substring(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 12), 16, 10) AS bigint) AS h")
    r = r.selectExpr("*", "h DIV 8 % 10 AS site", "h DIV 1000 % 3 AS k", "CAST(30 + h DIV 5000 % 10 AS int) AS a", f"array({', '.join(map(str, GAP_SIZES))})[CAST((sup + h DIV 8 % 10) % 5 AS int)] AS size")
    r = r.selectExpr("*", "(sup + 3 * site + k) % 3 AS copies").selectExpr("*", "IF(copies = 2 OR copies = 1 AND h % 2 = 0, size, 0) AS own", "h DIV 2 % 4 = 0 AS misplaced")
    put = "CASE own " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in PUT_IN.items()) + " ELSE '' END"
    # the window of a read's letters reaches from 39 before the gap to 35 after it
    near = f"concat({_WINDOW.format(k='sup, site')})"
    r = r.selectExpr("*", f"concat(substring({near}, 62 - a, a), {put}, substring({near}, 62 + greatest(-own, 0), 32)) AS seq")
    op = lambda n, o: f"named_struct('len', CAST({n} AS int), 'op', '{o}')"
    cigar = f"CASE WHEN own = 0 OR misplaced THEN array({op('length(seq)', 'M')}) WHEN own > 0 THEN array({op('a', 'M')}, {op('own', 'I')}, {op(32, 'M')}) ELSE array({op('a', 'M')}, {op('-own', 'D')}, {op(32, 'M')}) END"
    return r.selectExpr(
        "h AS ord", "qid", "concat('r', h) AS qname", "CAST(IF(h DIV 4000 % 2 = 1, 16, 0) + IF(h % 97 = 0, 1024, 0) AS int) AS flag", "concat('s', sup) AS rname", "CAST(100 * site + 61 - a AS int) AS pos", "60 AS mapq",
        f"{cigar} AS cigar", "seq", "repeat('I', CAST(length(seq) AS int)) AS qual", "concat('n', k) AS sample", "site", "size", "copies",
    )


_PLANTED = f"""hashed AS (SELECT l_suppkey AS sup, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 12))::BIGINT AS h FROM lineitem),
placed AS (SELECT *, h // 8 % 10 AS site, h // 1000 % 3 AS k, {list(GAP_SIZES)}[(sup + h // 8 % 10) % 5 + 1] AS size, h // 4000 % 2 = 1 AS reverse FROM hashed WHERE h % 97 <> 0),
planted AS (SELECT *, (sup + 3 * site + k) % 3 AS copies, copies = 2 OR copies = 1 AND h % 2 = 0 AS alt FROM placed),
seen AS (SELECT sup, site FROM planted WHERE alt AND h // 2 % 4 <> 0 GROUP BY ALL)"""
#: Two-sided exact test of tables (key, rf, rr, af, ar), as phred.
_PHRED = """, ways AS (SELECT *, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(s + 1) + lgamma(n - s + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r - k + 1) - lgamma(s - k + 1) - lgamma(n - r - s + k + 1)) AS p
  FROM (SELECT *, unnest(generate_series(greatest(0, r + s - n), least(r, s))) AS k FROM (SELECT key, rf, rf + rr AS r, rf + af AS s, rf + rr + af + ar AS n FROM tables))),
strand AS (SELECT key, cast(least(floor(-4.343 * ln(least(1.0, sum(CASE WHEN p <= own * (1 + 1e-7) THEN p ELSE 0 END))) + 0.499), 255) AS int) AS sp FROM (SELECT *, max(CASE WHEN k = rf THEN p END) OVER (PARTITION BY key) AS own FROM ways) GROUP BY key)"""
_FOUR = ", ".join(f"cast(count(*) FILTER (WHERE {'' if a else 'NOT '}alt AND {'' if b else 'NOT '}reverse) AS int) AS {'ra'[a]}{'fr'[b]}" for a in (0, 1) for b in (0, 1))
_TABLES = "cast(rf + rr + af + ar AS int) AS dp, cast(af + ar AS int) AS dv, rf, rr, af, ar, sp FROM tables JOIN strand USING (key)"


@query(
    f""", planted AS (SELECT *, base <> 'A' AS alt, flag & 16 <> 0 AS reverse FROM pile),
tables AS (SELECT {{'c': tid, 'p': p, 's': qid % 3}} AS key, {_FOUR} FROM planted GROUP BY key){_PHRED}
SELECT key.c AS tid, cast(key.p AS int) AS pos, cast(key.s AS int) AS sample, {_TABLES}""",
    P.READS, _PILE,
)
def sample_strand_fields(spark, d):
    """Depth, bases other than the reference and strand bias of each sample at each position."""
    pile = _with_bases(depth.pileup(P.reads(spark, d))).selectExpr("tid", "p AS pos", "CAST(qid % 3 AS int) AS sample", "base <> 'A' AS alt", "(flag & 16) <> 0 AS reverse", "1 AS n")
    return gap_calls.sample_strands(pile, ["tid", "pos", "sample"])


@query(
    f""", tables AS (SELECT {{'c': sup, 'p': site, 's': k}} AS key, {_FOUR} FROM planted JOIN seen USING (sup, site) GROUP BY key){_PHRED}
SELECT 's' || key.c AS rname, cast(100 * key.p + 60 AS int) AS pos, 'n' || key.s AS sample, {_TABLES}""",
    _PLANTED,
)
def gap_strands(spark, d):
    """Reads of each sample at called gaps that speak for one, by strand."""
    return gap_calls.call_gaps(planted_gaps(spark, d), planted_reference(spark, d))[1]


@query(
    f"""SELECT 's' || sup AS rname, cast(100 * site + 60 AS int) AS pos, '{MOTIF}'[1:1 + greatest(-size, 0)] AS ref, '{MOTIF[0]}' || CASE size {' '.join(f"WHEN {n} THEN '{x}'" for n, x in PUT_IN.items())} ELSE '' END AS alt,
'n' || k AS sample, cast(count(*) AS int) AS dp, ['0/0', '0/1', '1/1'][copies + 1] AS gt FROM planted JOIN seen USING (sup, site) GROUP BY ALL""",
    _PLANTED,
)
def gap_genotypes(spark, d):
    """Gaps called from reads to records; SQL knows what was planted."""
    s = gap_calls.call_gaps(planted_gaps(spark, d), planted_reference(spark, d))[0].select("rname", "pos", "ref", F.array_join("alts", ",").alias("alt"), F.explode("samples").alias("s"))
    return s.select("rname", "pos", "ref", "alt", "s.sample", "s.dp", "s.gt")


#: What calls of two gaps become, written out: first, second, reference, alternatives.
_GAP_SITES = """written(a, b, ref, alt) AS (VALUES ('*', '+GG', 'N', 'NGG'), ('*', '-ACT', 'NACT', 'N'), ('-AC', '*', 'NAC', 'N'), ('-AC', '+GG', 'NAC', 'NGGNN,N'), ('-AC', '-ACT', 'NACT', 'NN,N'),
  ('+T', '*', 'N', 'NT'), ('+T', '+GG', 'N', 'NT,NGG'), ('+T', '-ACT', 'NACT', 'NTNNN,N'), ('-G', '*', 'NG', 'N'), ('-G', '+GG', 'NG', 'NGGN,N'), ('-G', '-ACT', 'NACT', 'NNN,N'))"""


@query("SELECT 'chr' || tid AS chrom, pos, ref, alt, mapq AS qual FROM reads JOIN written ON a = ['*', '-AC', '+T', '-G'][qid % 4 + 1] AND b = ['*', '+GG', '-ACT'][qid // 4 % 3 + 1]", P.READS, _GAP_SITES)
def gap_sites(spark, d):
    r = P.reads(spark, d).selectExpr("concat('chr', tid) AS chrom", "pos", "mapq AS qual", "array('*', '-AC', '+T', '-G')[CAST(qid % 4 AS int)] AS first", "array('*', '+GG', '-ACT')[CAST(qid DIV 4 % 3 AS int)] AS second")
    return gaps.gaps_to_sites(r)


_MEET = "CASE WHEN {s} = '{x}' THEN {s} WHEN {q} < 40 THEN '{x}' ELSE {s} END", "chr(33 + CASE WHEN {s} = '{x}' THEN greatest({q}, 40) ELSE abs({q} - 40) END)"
_LETTERS, _VALUES = (" || ".join(m.format(s=f"substr(seq, l - {1 - k}, 1)", q=f"(ascii(substr(qual, l - {1 - k}, 1)) - 33)", x=x) for k, x in enumerate("AC")) for m in _MEET)


@query(
    f"""SELECT ord, CASE WHEN kind = 0 AND l < 2 THEN flag | 4 ELSE flag END AS flag, CASE WHEN kind = 0 AND l < 2 THEN cigar || '2B2M' ELSE cigar END AS cigar,
CASE WHEN kind <> 0 THEN seq WHEN l < 2 THEN seq || 'AC' ELSE left(seq, l - 2) || {_LETTERS} END AS seq, CASE WHEN kind <> 0 THEN qual WHEN l < 2 THEN qual || 'II' ELSE left(qual, l - 2) || {_VALUES} END AS qual FROM records""",
    P.READS, RECORDS,
)
def collapsed_overlaps(spark, d):
    r = whole_reads(spark, d).select("ord", "flag", "cigar", "seq", "qual")
    plain, more = F.size("cigar") == 1, R.parse_cigar(F.lit("2B2M"))
    r = r.withColumns({"cigar": F.when(plain, F.concat("cigar", more)).otherwise(F.col("cigar")), "seq": F.when(plain, F.concat("seq", F.lit("AC"))).otherwise(F.col("seq")), "qual": F.when(plain, F.concat("qual", F.lit("II"))).otherwise(F.col("qual"))})
    return gaps.collapse_overlaps(r).withColumn("cigar", R.format_cigar("cigar"))


@query(f"SELECT cast(site % 2 AS int) AS file, {_LINE} FROM lines", SITES, SITE_LINES)
def sites_cat(spark, d):
    """Site lines written as two files and read one after the other."""
    v, header = site_lines(spark, d), _site_header(spark)
    paths = []
    for k in (0, 1):
        paths.append(shared_path(spark, f"part{k}.vcf"))
        store.write_text(text.format_vcf(v.where(F.substring("id", 3, 20).cast("long") % 2 == k)), paths[-1], header)
    return _shown(store.concatenate_sites(spark, paths), "file")


@query()
def variant_filter(spark, d):
    """Site lines six positions apart with annotations for all filters, near gaps, MNPs and each other."""
    v = site_lines(spark, d).withColumn("site", F.expr("CAST(substring(id, 3) AS long)"))
    two = F.col("site") % 5 == 1
    info = F.create_map(
        F.lit("DP"), F.col("info")["DP"], F.lit("DP4"), F.concat_ws(",", *[(F.col("site") * k % 7).cast("string") for k in (1, 2, 3, 5)]), F.lit("MQ"), F.col("info")["MQ"], F.lit("MXSP"), (F.col("site") % 1003).cast("string"),
        F.lit("PV4"), F.concat_ws(",", F.when(F.col("site") % 31 == 0, "1e-9").otherwise("0.2"), F.lit("0.5"), F.lit("0.4"), F.lit("1")), F.lit("G3"), F.lit("0,0.6,0.4"), F.lit("HWE"), F.when(F.col("site") % 29 == 0, "1e-7").otherwise("0.4"),
    )
    v = v.select("chrom", (F.col("site") * 2).cast("int").alias("pos"), F.col("site").alias("id"), F.when(two, F.concat("ref", F.lit("ACGTACGT"))).otherwise(F.col("ref")).alias("ref"), F.when(two, F.array(F.concat(F.element_at("alt", 1), F.lit("TTTTTTTT")))).otherwise(F.col("alt")).alias("alt"), "qual", info.alias("info"))
    return walks.variant_filter(v).select("chrom", "pos", "id", "filter")


@query()
def pileup_site_filter(spark, d):
    r = P.reads(spark, d).groupBy("tid", "pos").agg(F.count(F.lit(1)).cast("int").alias("depth"), F.max("mapq").cast("int").alias("mapq"), F.sum("qid").alias("_q"))
    r = r.selectExpr("concat('chr', tid) AS chrom", "CAST(pos * 12 AS int) AS pos", "_q % 4 = 0 AS is_gap", "CAST(_q % 61 AS int) AS quality", "mapq", "depth", "CAST(_q % 2 AS int) AS support", "CAST(IF(_q % 8 = 0, 3, 0) AS int) AS deleted")
    return gaps.pileup_filter(r)
