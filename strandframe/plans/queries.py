"""Registered queries over the projections, with the same question in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import any_of, bin_of, none_of, reverse_complement
from ..model import CONSENSUS_SKIP, PILEUP_SKIP
from ..functions import reads as R
from ..operators import calling, codec, consensus, depth, intervals, phasing, position_bias, quality, records, search, sequence_stats, sites, variants, walks
from ..sources.shared import shared_path
from . import projections as P

PATTERN = "ACGTA"
PATTERNS = ["ACGT", "AAA", "NAC", "GATTA"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, *ctes: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = (f"WITH {', '.join(ctes)}{'' if sql.startswith(',') else ' '}" if ctes else "") + sql
        return f

    return add


def _hits(pattern: str) -> str:
    m = len(pattern)
    return f"SELECT seq, cast(o AS int) AS \"offset\" FROM (SELECT seq, seqs, unnest(generate_series(0, length(seqs) - {m})) AS o FROM sequences WHERE length(seqs) >= {m}) WHERE substr(seqs, o + 1, {m}) = '{pattern}'"


@query(_hits(PATTERN), P.SEQUENCES)
def pattern_search(spark, d):
    return search.pattern_search(P.sequences(spark, d), PATTERN)


@query(_hits(PATTERN), P.SEQUENCES)
def pattern_search_native(spark, d):
    return search.pattern_search_native(P.sequences(spark, d), PATTERN)


@query(_hits("GATTA"), P.SEQUENCES)
def pattern_dfa(spark, d):
    return search.pattern_search(P.sequences(spark, d), "gatta", "dfa")


@query(_hits("GATTA"), P.SEQUENCES)
def pattern_bmh(spark, d):
    return search.pattern_search(P.sequences(spark, d), "GATTA", "bmh")


@query(_hits("AAA"), P.SEQUENCES)
def pattern_signature(spark, d):
    return search.pattern_search(P.sequences(spark, d), "AAA", "lm")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, * FROM ({_hits(p)})" for p in PATTERNS), P.SEQUENCES)
def pattern_search_multi(spark, d):
    return search.pattern_search_multi(P.sequences(spark, d), PATTERNS)


def _groups(spark, d) -> DataFrame:
    return P.alignments(spark, d).withColumn("grp", F.floor(F.col("seq") / 8).cast("long"))


@query("SELECT seq, coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE s <> '-'), '') AS seqs FROM colops GROUP BY seq", P.ALIGNMENTS)
def codec_roundtrip(spark, d):
    return _roundtrip(_groups(spark, d))


def _references(a: DataFrame) -> DataFrame:
    return a.select("grp", "seq", F.replace("ref_aln", F.lit("-"), F.lit("")).alias("ref"))


def _roundtrip(a: DataFrame) -> DataFrame:
    return codec.decompress_groups(codec.compress_groups(a), _references(a))


_DECODED = "decoded AS (SELECT seq, coalesce(string_agg(s, '' ORDER BY k) FILTER (WHERE s <> '-'), '') AS seqs FROM colops GROUP BY seq)"


def _loaded(a: DataFrame) -> DataFrame:
    return codec.load_groups(codec.compress_groups(a), _references(a))


@query(_hits(PATTERN).replace("FROM sequences", "FROM decoded"), P.ALIGNMENTS, _DECODED)
def pattern_compressed(spark, d):
    return codec.search_groups(_loaded(_groups(spark, d)), PATTERN)


@query(_hits("AAA").replace("FROM sequences", "FROM decoded"), P.ALIGNMENTS, _DECODED)
def pattern_compressed_overlapping(spark, d):
    return codec.search_groups(_loaded(_groups(spark, d)), "aaa")


#: What a stored index is searched for, one search after the other: overlapping, nested and repeated patterns, in either case.
SEARCHES = [["ACGT", "acg", "AAA", "NAC", "GATTA", "ACGT"], [PATTERN, "TTAN", "A"]]


@query(" UNION ALL ".join(f"SELECT {k} AS search, '{p}' AS pattern, * FROM ({_hits(p)})".replace("FROM sequences", "FROM decoded") for k, ps in enumerate(SEARCHES) for p in sorted({x.upper() for x in ps})), P.ALIGNMENTS, _DECODED)
def pattern_index(spark, d):
    """The compressed form is stored as an index once, then opened and searched twice for many patterns."""
    path = shared_path(spark, "phrases")
    codec.save_index(_loaded(_groups(spark, d)), path)
    first, second = (codec.search_many(codec.open_index(spark, path), ps).select(F.lit(k).alias("search"), "*") for k, ps in enumerate(SEARCHES))
    return first.unionByName(second)


@query()
def codec_stats(spark, d):
    return codec.codec_stats(_groups(spark, d))


@query(
    """SELECT seq, op, count(*) AS columns, count(*) FILTER (WHERE before IS NULL OR before <> op) AS runs FROM (
  SELECT seq, op, lag(op) OVER (PARTITION BY seq ORDER BY k) AS before FROM (
    SELECT seq, k, CASE WHEN r = '-' THEN 'I' WHEN s = '-' THEN 'D' WHEN r = s THEN 'M' ELSE 'X' END AS op FROM colops WHERE NOT (r = '-' AND s = '-'))) GROUP BY seq, op""",
    P.ALIGNMENTS,
)
def op_runs(spark, d):
    return _op_runs(P.alignments(spark, d))


def _op_runs(a: DataFrame) -> DataFrame:
    return codec.op_runs(a).select("seq", "op", F.col("columns").cast("long").alias("columns"), F.col("runs").cast("long").alias("runs"))


@query(
    """, pos AS (SELECT seq // 8 AS corpus, p AS pos, max(CASE WHEN r = s THEN 0 ELSE 1 END) AS changed FROM (SELECT seq, r, s, cast(row_number() OVER (PARTITION BY seq ORDER BY k) - 1 AS int) AS p FROM colops WHERE r <> '-') GROUP BY ALL)
SELECT a.corpus, a.pos FROM pos a JOIN pos b ON a.corpus = b.corpus AND a.pos = b.pos + 1 WHERE b.changed = 1 AND a.changed = 0""",
    P.ALIGNMENTS,
)
def sync_map(spark, d):
    """For each corpus of eight sequences."""
    return codec.sync_map(P.alignments(spark, d).withColumn("corpus", F.floor(F.col("seq") / 8)), ("corpus",))


@query("SELECT b AS base, cast(sum(length(seqs) - length(replace(seqs, b, ''))) AS bigint) AS n FROM sequences, (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) t(b) GROUP BY b", P.SEQUENCES)
def base_composition(spark, d):
    return sequence_stats.base_composition(P.sequences(spark, d))


@query(
    "SELECT cast(k - 1 AS int) AS cycle, count(*) FILTER (WHERE substr(seqs, k, 1) IN ('G', 'C')) AS gc, count(*) AS total FROM (SELECT seqs, unnest(generate_series(1, length(seqs))) AS k FROM sequences) GROUP BY k",
    P.SEQUENCES,
)
def gc_by_cycle(spark, d):
    return sequence_stats.gc_by_cycle(P.sequences(spark, d))


@query(
    "SELECT substr(r, 1, 1) AS base, length(r) AS len, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seqs, '(A{3,})|(C{3,})|(G{3,})|(T{3,})')) AS r FROM sequences) GROUP BY 1, 2",
    P.SEQUENCES,
)
def homopolymer_runs(spark, d):
    return sequence_stats.homopolymer_runs(P.sequences(spark, d))


@query("SELECT seq, reverse(translate(seqs, 'ACGT', 'TGCA')) AS rc FROM sequences", P.SEQUENCES)
def reverse_complement_all(spark, d):
    return P.sequences(spark, d).select("seq", reverse_complement("seqs").alias("rc"))


@query("SELECT seq, md5(seqs) AS md5 FROM sequences", P.SEQUENCES)
def sequence_digests(spark, d):
    return sequence_stats.sequence_digests(P.sequences(spark, d))


@query("SELECT seq, concat('@s', seq, chr(10), seqs, chr(10), '+', chr(10), repeat('B', length(seqs))) AS record FROM sequences WHERE length(seqs) > 0", P.SEQUENCES)
def to_fastq(spark, d):
    return P.sequences(spark, d).where(F.length("seqs") > 0).select("seq", F.concat_ws("\n", F.concat(F.lit("@s"), "seq"), "seqs", F.lit("+"), F.repeat(F.lit("B"), F.length("seqs"))).alias("record"))


@query("SELECT ord, concat_ws(chr(9), 'chr' || tid, pos, e, 'q' || qid, mapq, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END) AS line FROM reads WHERE flag & 4 = 0", P.READS)
def to_bed(spark, d):
    r = P.reads(spark, d).where(none_of("flag", 4))
    return r.select("ord", F.concat_ws("\t", F.concat(F.lit("chr"), "tid"), "pos", "e", F.concat(F.lit("q"), "qid"), "mapq", F.when(any_of("flag", 16), "-").otherwise("+")).alias("line"))


@query("SELECT * FROM reads WHERE mapq >= 20 AND flag & 2 = 2 AND flag & 1024 = 0 AND e - pos >= 10", P.READS)
def view_filter(spark, d):
    r = P.reads(spark, d).withColumn("qlen", F.col("e") - F.col("pos"))
    return records.view(r, 20, 2, 1024, 10).drop("qlen")


@query("SELECT count(*) AS n FROM reads WHERE mapq >= 20 AND flag & 2 = 2 AND flag & 1024 = 0", P.READS)
def view_count(spark, d):
    return records.view(P.reads(spark, d), 20, 2, 1024).agg(F.count(F.lit(1)).alias("n"))


_X31 = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split('read' || (qid * 62710561), ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296)"


@query(f"SELECT ord, qid FROM reads WHERE (({_X31} + 11) % 16777216) / 16777216.0 < 0.5", P.READS)
def subsample(spark, d):
    return records.view(P.reads(spark, d).withColumn("qname", F.concat(F.lit("read"), F.col("qid") * 62710561)), fraction=0.5, seed=11, name="qname").select("ord", "qid")


@query("SELECT ord, qid FROM reads WHERE flag & 4 = 0 AND flag & 64 <> 0 AND mapq >= 10 AND flag & 2 <> 0", P.READS)
def pileup_read_filter(spark, d):
    return records.pileup_filter(P.reads(spark, d), require_any=64, min_mapq=10).select("ord", "qid")


_FLAGS = """count(*) AS total, count(*) FILTER (WHERE flag & 1024 <> 0) AS dup, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 1 <> 0) AS paired,
count(*) FILTER (WHERE flag & 64 <> 0) AS read1, count(*) FILTER (WHERE flag & 128 <> 0) AS read2, count(*) FILTER (WHERE flag & 2 = 2) AS proper,
count(*) FILTER (WHERE flag & 4 = 0 AND flag & 8 = 0) AS both_mapped, count(*) FILTER (WHERE flag & 4 = 0 AND flag & 8 <> 0) AS singletons,
count(*) FILTER (WHERE flag & 4 = 0 AND flag & 8 = 0 AND mtid <> tid) AS diff_chr, count(*) FILTER (WHERE flag & 4 = 0 AND flag & 8 = 0 AND mtid <> tid AND mapq >= 5) AS diff_chr_q5"""


@query(f"SELECT flag & 512 <> 0 AS qcfail, {_FLAGS} FROM (SELECT *, qid % 5 AS mtid FROM reads) GROUP BY 1", P.READS)
def flagstat(spark, d):
    return records.flagstat(P.reads(spark, d).withColumn("mtid", F.col("qid") % 5))


@query(
    """SELECT name, len, coalesce(m, 0)::BIGINT AS mapped, coalesce(u, 0)::BIGINT AS unmapped FROM contigs LEFT JOIN (SELECT tid, count(*) FILTER (WHERE flag & 4 = 0) AS m, count(*) FILTER (WHERE flag & 4 <> 0) AS u FROM reads GROUP BY tid) USING (tid)
UNION ALL SELECT '*', 0, 0, count(*) FROM reads WHERE tid < 0""",
    P.READS, P.CONTIG_SQL,
)
def idxstats(spark, d):
    return records.idxstats(P.reads(spark, d), P.contigs(spark))


@query("SELECT * FROM reads WHERE tid = 2 AND pos < 1500 AND greatest(e, pos + 1) > 1400", P.READS)
def region_fetch(spark, d):
    return intervals.region_fetch(P.reads(spark, d), 2, 1400, 1500)


@query("SELECT r.ord, g.rid FROM reads r JOIN regions g ON r.tid = g.tid AND r.pos < g.e AND g.b < r.e WHERE g.rid % 50 = 0", P.READS, P.REGIONS)
def region_fetch_multi(spark, d):
    return intervals.fetch_regions(P.reads(spark, d), P.regions(spark, d).where("rid % 50 = 0")).select("ord", "rid")


@query("SELECT * FROM reads r WHERE e > pos AND EXISTS (SELECT 1 FROM regions g WHERE g.tid = r.tid AND r.pos < g.e AND g.b < r.e)", P.READS, P.REGIONS)
def bed_semi_join(spark, d):
    return intervals.overlap_semi(P.reads(spark, d), P.regions(spark, d))


@query(
    """SELECT g.rid, g.tid, g.b, g.e, cast(coalesce(sum(least(g.e, r.e) - greatest(g.b, r.pos)), 0) AS bigint) AS cov
FROM regions g LEFT JOIN reads r ON r.tid = g.tid AND r.pos < g.e AND g.b < r.e GROUP BY ALL""",
    P.READS, P.REGIONS,
)
def bedcov(spark, d):
    return intervals.coverage(P.reads(spark, d), P.regions(spark, d))


_DEPTH = f"SELECT tid, pos, count(*) AS depth FROM (SELECT tid, unnest(generate_series(pos, e - 1))::INT AS pos FROM reads WHERE flag & {PILEUP_SKIP} = 0 AND mapq >= 10 AND e > pos) GROUP BY tid, pos"


@query(_DEPTH, P.READS)
def depth_sweep(spark, d):
    return depth.sweep(P.reads(spark, d), 10)


@query(_DEPTH, P.READS)
def depth_explode(spark, d):
    return depth.exploded(P.reads(spark, d), 10)


@query(
    f"SELECT tid, pos, count(*) FILTER (WHERE file = 0) AS d0, count(*) FILTER (WHERE file = 1) AS d1 FROM (SELECT tid, unnest(generate_series(pos, e - 1))::INT AS pos, qid % 2 AS file FROM reads WHERE flag & {PILEUP_SKIP} = 0) GROUP BY tid, pos",
    P.READS,
)
def multi_depth(spark, d):
    return depth.multi(P.reads(spark, d).withColumn("file", F.col("qid") % 2), [0, 1])


def _with_bases(pile: DataFrame) -> DataFrame:
    return pile.withColumns({"base": F.substring(F.lit("ACGT"), ((F.col("qid") + F.col("p")) % 4 + 1).cast("int"), F.lit(1)), "baseq": ((F.col("qid") * 3 + F.col("p")) % 41).cast("int"), "len": F.col("e") - F.col("pos")})


_PILE = f"pile AS (SELECT *, p - pos AS qpos, p = pos AS is_head, p = e - 1 AS is_tail, substr('ACGT', cast((qid + p) % 4 + 1 AS int), 1) AS base, cast((qid * 3 + p) % 41 AS int) AS baseq, e - pos AS len FROM (SELECT *, unnest(generate_series(pos, e - 1))::INT AS p FROM reads WHERE flag & {PILEUP_SKIP} = 0 AND e > pos))"


@query("SELECT tid, p AS pos, count(*) AS n, count(*) FILTER (WHERE is_head) AS heads, count(*) FILTER (WHERE is_tail) AS tails, cast(sum(qpos) AS bigint) AS qpos FROM pile GROUP BY 1, 2", P.READS, _PILE)
def pileup_counts(spark, d):
    return _pileup_counts(P.reads(spark, d))


def _pileup_counts(reads: DataFrame) -> DataFrame:
    p = depth.pileup(reads)
    return p.groupBy("tid", F.col("p").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_head").alias("heads"), F.count_if("is_tail").alias("tails"), F.sum("qpos").cast("long").alias("qpos"))


@query(
    """SELECT tid, p AS pos, count(*) AS n,
string_agg(CASE WHEN is_head THEN '^' || chr(mapq + 33) ELSE '' END || CASE WHEN flag & 16 <> 0 THEN lower(base) ELSE base END || CASE WHEN is_tail THEN '$' ELSE '' END, '' ORDER BY ord) AS bases,
string_agg(chr(baseq + 33), '' ORDER BY ord) AS quals FROM pile WHERE baseq >= 13 GROUP BY 1, 2""",
    P.READS, _PILE,
)
def mpileup_text(spark, d):
    return depth.text(_with_bases(depth.pileup_tiles(P.reads(spark, d))))


_PLACES = """places AS (SELECT tid, p AS pos, cast(floor((qpos + 1)::DOUBLE / (len + 1) * 100) AS int) AS place, count(*) FILTER (WHERE base = 'A') AS r, count(*) FILTER (WHERE base <> 'A') AS a FROM pile GROUP BY ALL),
ranked AS (SELECT *, sum(r) OVER (PARTITION BY tid, pos ORDER BY place) AS before, CASE WHEN place < 50 THEN place ELSE 100 - place END AS near FROM places),
centred AS (SELECT *, sum(near * a) OVER w / nullif(sum(a) OVER w, 0)::DOUBLE AS mean FROM ranked WINDOW w AS (PARTITION BY tid, pos)),
biased AS (SELECT tid, pos, sum(r)::BIGINT AS n_ref, sum(a)::BIGINT AS n_alt, sum(before * a)::BIGINT AS u, sum(abs(near - mean) * a) / nullif(sum(a), 0)::DOUBLE AS distance FROM centred GROUP BY tid, pos)"""


@query("SELECT tid, pos, n_ref, n_alt, u, round(distance, 6) AS distance FROM biased", P.READS, _PILE, _PLACES)
def read_place_sums(spark, d):
    return _place_sums(spark, d).withColumn("distance", F.round("distance", 6))


def _place_sums(spark, d):
    pile = _with_bases(depth.pileup(P.reads(spark, d))).withColumns({"ref": F.lit("A"), "pos": F.col("p")})
    return position_bias.place_sums(position_bias.place_counts(pile))


@query(
    """SELECT tid, pos, n_ref, n_alt, round((u - (n_ref * n_alt + 1) / 2.0) / sqrt(n_ref * n_alt * (n_ref + n_alt + 1) / 12.0), 6) AS rank_z,
CASE WHEN n_alt >= 24 THEN round(exp(-0.5 * pow((distance - 12.5) / (1.476 / (0.182 * pow(least(n_alt, 100), 0.514))), 2)) / (1.476 / (0.182 * pow(least(n_alt, 100), 0.514)) * sqrt(2 * pi())), 6) END AS distance_bias
FROM biased WHERE n_ref >= 8 AND n_alt >= 24""",
    P.READS, _PILE, _PLACES,
)
def read_place_bias(spark, d):
    """Sites deep enough for the normal curve; the tests hold shallow ones against all orders of letters."""
    b = position_bias.position_bias(_place_sums(spark, d)).where("n_ref >= 8 AND n_alt >= 24")
    return b.withColumns({c: F.round(c, 6) for c in ("rank_z", "distance_bias")})


def _sums() -> str:
    rev, tail = "flag & 16 <> 0", "least(least(qpos, len - 1 - qpos), 25)"
    out = [f"count(*) FILTER (WHERE base {o} 'A' AND {n}({rev})) AS {k}" for o, n, k in (("=", "NOT ", "rf"), ("=", "", "rr"), ("<>", "NOT ", "af"), ("<>", "", "ar"))]
    for name, v in (("bq", "baseq"), ("mq", "mapq"), ("td", tail)):
        for side, o in (("r", "="), ("a", "<>")):
            out += [f"cast(sum(CASE WHEN base {o} 'A' THEN {v} ELSE 0 END) AS bigint) AS {name}_{side}", f"cast(sum(CASE WHEN base {o} 'A' THEN {v} * {v} ELSE 0 END) AS bigint) AS {name}2_{side}"]
    return ", ".join(out)


@query(f"SELECT tid, p AS pos, {_sums()} FROM pile GROUP BY 1, 2", P.READS, _PILE)
def site_annotation(spark, d):
    return _site_sums(P.reads(spark, d))


def _site_sums(reads: DataFrame) -> DataFrame:
    return depth.site_sums(_with_bases(depth.pileup(reads)).withColumn("ref", F.lit("A")))


_COORD = "tid < 0, tid, pos, flag & 16, ord"


@query(f"SELECT ord, cast(row_number() OVER (PARTITION BY tid ORDER BY {_COORD}) AS int) AS rank FROM reads", P.READS)
def coord_sort_rank(spark, d):
    return records.coordinate_rank(P.reads(spark, d)).select("ord", F.col("rank").cast("int").alias("rank"))


@query("SELECT ord, cast(row_number() OVER (PARTITION BY qid % 64 ORDER BY qid, flag & 192, ord) AS int) AS rank FROM reads", P.READS)
def name_sort_rank(spark, d):
    from ..functions.reads import natural_key

    w = Window.partitionBy(F.col("qid") % 64).orderBy(natural_key(F.concat(F.lit("q"), F.col("qid").cast("string"))), F.col("flag").bitwiseAND(192), "ord")
    return P.reads(spark, d).select("ord", F.row_number().over(w).alias("rank"))


@query("SELECT ord, tid, pos, CASE WHEN qid % 2 = 0 THEN 0 ELSE 1 END AS file FROM reads", P.READS)
def merge_tagged(spark, d):
    return _merge_tagged(P.reads(spark, d))


def _merge_tagged(r: DataFrame) -> DataFrame:
    return records.merge_sorted(r.where("qid % 2 = 0"), r.where("qid % 2 = 1")).select("ord", "tid", "pos", "file")


@query("SELECT * FROM reads", P.READS)
def cat(spark, d):
    r = P.reads(spark, d)
    return records.concatenate([r.where(f"tid = {k}") for k in range(P.CONTIGS)] + [r.where(f"tid is null or tid not between 0 and {P.CONTIGS - 1}")])


@query("SELECT ord, x AS x31, h AS wang FROM (SELECT ord, x, xor(h, h // 65536) AS h FROM (SELECT ord, x, (h + xor((h * 2048) & 4294967295, 4294967295)) & 4294967295 AS h FROM (SELECT ord, x, xor(h, h // 64) AS h FROM (SELECT ord, x, (h + h * 8) & 4294967295 AS h FROM (SELECT ord, x, xor(h, h // 1024) AS h FROM (SELECT ord, x, (h + xor((h * 32768) & 4294967295, 4294967295)) & 4294967295 AS h FROM (SELECT ord, x, x AS h FROM hashed)))))))", P.READS, f"hashed AS (SELECT ord, {_X31} AS x FROM reads)")
def name_hashes(spark, d):
    """Both hashes of template names: the rolling one, and the mix of it."""
    x = P.reads(spark, d).select("ord", R.x31(F.concat(F.lit("read"), (F.col("qid") * 62710561).cast("string"))).alias("x31"))
    return x.withColumn("wang", R.wang("x31"))


@query(f"SELECT ord, qid, {_X31} AS hash, cast({_X31} % 16 AS int) AS bucket FROM reads", P.READS)
def bucket_shuffle(spark, d):
    return records.bucket_shuffle(P.reads(spark, d).withColumn("qname", F.concat(F.lit("read"), F.col("qid") * 62710561)), 16, "qname").select("ord", "qid", "hash", "bucket")


@query(
    "SELECT ord, qid, tid, pos, e, mapq, flag FROM (SELECT *, row_number() OVER (PARTITION BY tid, flag & 16, CASE WHEN flag & 16 <> 0 THEN e ELSE pos END ORDER BY mapq DESC, ord) AS k FROM reads) WHERE k = 1",
    P.READS,
)
def rmdup_single(spark, d):
    return records.rmdup_single(P.reads(spark, d))


@query("SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY qid % 3, tid, pos, (e - pos) // 10 ORDER BY mapq DESC, ord) AS k FROM reads) WHERE k = 1", P.READS)
def rmdup_pair(spark, d):
    p = P.reads(spark, d).withColumns({"lib": F.col("qid") % 3, "isize": F.floor((F.col("e") - F.col("pos")) / 10), "score": F.col("mapq")})
    return records.rmdup_pair(p).select("ord")


@query(
    """SELECT qid, ord, mapq AS best, cast(CASE WHEN mapq > 0 THEN floor(250.0 * (mapq - coalesce(second, 0)) / mapq) ELSE 0 END AS int) AS new_mapq, hits FROM (
SELECT *, row_number() OVER w AS k, lead(mapq) OVER w AS second, count(*) OVER (PARTITION BY qid) AS hits FROM reads WINDOW w AS (PARTITION BY qid ORDER BY mapq DESC, ord)) WHERE k = 1""",
    P.READS,
)
def best_hit(spark, d):
    return records.best_hit(P.reads(spark, d))


@query(
    """SELECT qid, ord, tid, pos,
cast(CASE WHEN mt IS NULL THEN flag & ~43 ELSE ((flag & ~40) | (CASE WHEN mf & 4 <> 0 THEN 8 ELSE 0 END) | (CASE WHEN mf & 16 <> 0 THEN 32 ELSE 0 END)) & (CASE WHEN (flag | mf) & 4 <> 0 THEN ~2 ELSE ~0 END) END AS int) AS flag,
coalesce(mt, -1) AS mtid, coalesce(mp, -1) AS mpos,
cast(CASE WHEN mt IS NOT NULL AND (flag | mf) & 4 = 0 AND tid = mt THEN (CASE WHEN mf & 16 <> 0 THEN me ELSE mp END) - (CASE WHEN flag & 16 <> 0 THEN e ELSE pos END) ELSE 0 END AS int) AS isize
FROM (SELECT *, CASE WHEN k % 2 = 1 THEN lag(tid) OVER w ELSE lead(tid) OVER w END AS mt, CASE WHEN k % 2 = 1 THEN lag(pos) OVER w ELSE lead(pos) OVER w END AS mp,
 CASE WHEN k % 2 = 1 THEN lag(e) OVER w ELSE lead(e) OVER w END AS me, CASE WHEN k % 2 = 1 THEN lag(flag) OVER w ELSE lead(flag) OVER w END AS mf
 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord) - 1 AS k FROM reads) WINDOW w AS (PARTITION BY qid ORDER BY ord))""",
    P.READS,
)
def fixmate(spark, d):
    return records.fixmate(P.reads(spark, d))


@query(
    """, a AS (SELECT qid, min(tid) AS tid, min(pos) AS pos, min(mapq) AS mapq FROM reads WHERE flag & 64 <> 0 GROUP BY qid), b AS (SELECT qid, min(tid) AS tid, min(pos) AS pos, min(mapq) AS mapq FROM reads WHERE flag & 128 <> 0 GROUP BY qid)
SELECT CASE WHEN b.tid IS NULL THEN 'only_first' WHEN a.tid IS NULL THEN 'only_second' WHEN a.tid = b.tid AND abs(a.pos - b.pos) <= 40 THEN 'same' WHEN a.mapq > b.mapq THEN 'first_better' WHEN a.mapq < b.mapq THEN 'second_better' ELSE 'undecided' END AS outcome, count(*) AS n
FROM a FULL OUTER JOIN b ON a.qid = b.qid GROUP BY 1""",
    P.READS,
)
def read_compare(spark, d):
    r = P.reads(spark, d)
    side = lambda bit: r.where(any_of("flag", bit)).groupBy("qid").agg(F.min("tid").alias("tid"), F.min("pos").alias("pos"), F.min("mapq").alias("mapq"))
    return records.compare_reads(side(64), side(128), within=40)


@query(
    """, p AS (SELECT least(abs((qid * 7) % 500 - 100), 8000) AS isize, (flag & 16 <> 0) AS own, (qid % 2 = 1) AS mate, pos <= mapq * 40 AS first FROM reads)
SELECT cast(isize AS int) AS isize, count(*) FILTER (WHERE own <> mate AND first = (NOT own)) AS inward, count(*) FILTER (WHERE own <> mate AND first = own) AS outward, count(*) FILTER (WHERE own = mate) AS other FROM p GROUP BY 1""",
    P.READS,
)
def insert_size_classes(spark, d):
    r = P.reads(spark, d).withColumns({"isize": ((F.col("qid") * 7) % 500 - 100).cast("int"), "pnext": F.col("mapq") * 40, "flag": F.col("flag").bitwiseOR(F.when(F.col("qid") % 2 == 1, 32).otherwise(0))})
    return records.insert_sizes(r)


@query(
    f""", b AS (SELECT tid, p AS pos, ord, CASE WHEN mapq = 60 THEN 255 ELSE mapq END AS mapq, substr('ACGT', cast((qid + p) % 4 + 1 AS int), 1) AS base FROM (SELECT *, unnest(generate_series(pos, e - 1))::INT AS p FROM reads WHERE flag & {CONSENSUS_SKIP} = 0 AND e > pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY tid, pos ORDER BY ord) AS k FROM b),
g AS (SELECT *, row_number() OVER (PARTITION BY tid, pos ORDER BY CASE WHEN k = 1 AND mapq = 255 THEN 0 WHEN mapq <> 255 THEN 1 ELSE 2 END, mapq DESC, ord) AS j FROM f)
SELECT tid, pos, base, mapq FROM g WHERE j = 1""",
    P.READS,
)
def consensus_bases(spark, d):
    r = consensus.usable(P.reads(spark, d)).where("e > pos").withColumn("mapq", F.when(F.col("mapq") == 60, 255).otherwise(F.col("mapq")))
    b = consensus.with_ranks(r).withColumn("p", F.explode(F.sequence(F.col("pos"), F.col("e") - 1)))
    return consensus.winner(b.select("tid", F.col("p").alias("pos"), "ord", "mapq", "_first", "_best", F.substring(F.lit("ACGT"), ((F.col("qid") + F.col("p")) % 4 + 1).cast("int"), F.lit(1)).alias("base")))


@query(
    """SELECT rid, tid, cast(b + k * 12 AS int) AS tb, cast(CASE WHEN k = n - 1 THEN e ELSE b + k * 12 + 12 END AS int) AS te FROM (
SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, cast(greatest(1, ceil((e - b) / 12.0 - 0.1)) AS int) AS n FROM regions))""",
    P.REGIONS,
)
def tile_contigs(spark, d):
    return intervals.tiles(P.regions(spark, d), 12)


_BIN = "CASE " + " ".join(f"WHEN (pos * 40) >> {s} = (e * 40 - 1) >> {s} THEN {((1 << (29 - s)) - 1) // 7} + ((pos * 40) >> {s})" for s in (14, 17, 20, 23, 26)) + " ELSE 0 END"


@query(f"SELECT ord, cast({_BIN} AS int) AS bin FROM reads", P.READS)
def bin_assign(spark, d):
    return P.reads(spark, d).select("ord", bin_of(F.col("pos") * 40, F.col("e") * 40).alias("bin"))


_PL = "sites AS (SELECT vec_id AS site, list_transform(generate_series(0, 21), lambda k: list_transform(e[k * 3 + 1 : k * 3 + 3], lambda v: v - list_min(e[k * 3 + 1 : k * 3 + 3]))) AS pl FROM (SELECT vec_id, list_concat(list_transform(embedding, lambda x: least(255, cast(round(abs(x) * 600) AS int))), [0, 0]) AS e FROM embeddings))"


@query("SELECT site, cast(list_min([pl[1][1] + pl[2][1], pl[1][2] + pl[2][2], pl[1][3] + pl[2][3]]) - list_min(pl[1]) - list_min(pl[2]) AS bigint) AS llr FROM sites", _PL)
def pair_llr(spark, d):
    return variants.pair_llr(P.likelihoods(spark, d))


@query("SELECT list_sort(t)[2] - list_min(t) AS gap, count(*) AS n FROM (SELECT unnest(pl) AS t FROM sites) GROUP BY 1", _PL)
def likelihood_gaps(spark, d):
    return variants.likelihood_gaps(P.likelihoods(spark, d))


@query("SELECT site, cast(coalesce(sum(list_position(t, list_min(t)) - 1) FILTER (WHERE list_max(t) > 0), 0) AS bigint) AS ac, cast(2 * count(*) FILTER (WHERE list_max(t) > 0) AS bigint) AS an FROM (SELECT site, unnest(pl) AS t FROM sites) GROUP BY site", _PL)
def allele_counts(spark, d):
    return variants.allele_counts(P.likelihoods(spark, d))


@query("SELECT site, count(*) FILTER (WHERE b = 1) AS hom_a, count(*) FILTER (WHERE b = 2) AS het, count(*) FILTER (WHERE b = 3) AS hom_b FROM (SELECT site, list_position(t, list_min(t)) AS b FROM (SELECT site, unnest(pl) AS t FROM sites)) GROUP BY site", _PL)
def genotype_counts(spark, d):
    return variants.genotype_counts(P.likelihoods(spark, d))


@query("SELECT mapq AS qual, cast(sum(count(*)) OVER w AS bigint) AS n, cast(sum(count(*) FILTER (WHERE qid % 3 = 0)) OVER w AS bigint) AS ts, cast(sum(count(*) FILTER (WHERE qid % 3 <> 0)) OVER w AS bigint) AS tv FROM reads GROUP BY mapq WINDOW w AS (ORDER BY mapq DESC)", P.READS)
def quality_curve(spark, d):
    return variants.quality_curve(P.reads(spark, d).select(F.col("mapq").alias("qual"), (F.col("qid") % 3 == 0).alias("is_ts")))


@query()
def af_em(spark, d):
    return variants.site_frequencies(P.likelihoods(spark, d))


@query()
def ld_r2(spark, d):
    return variants.adjacent_ld(P.likelihoods(spark, d))


@query(
    """, best AS (SELECT site, list_position(t, list_min(t)) AS b FROM (SELECT site, unnest(pl) AS t FROM sites)),
tables AS (SELECT site, n, het, 2 * least(a, n - a - het) + het AS rare FROM (SELECT site, count(*) AS n, count(*) FILTER (WHERE b = 1) AS a, count(*) FILTER (WHERE b = 2) AS het FROM best GROUP BY site)),
ways AS (SELECT *, exp(w - max(w) OVER (PARTITION BY site)) AS p FROM (SELECT *, ln(2) * h - lgamma(h + 1) - lgamma((rare - h) // 2 + 1) - lgamma(n - h - (rare - h) // 2 + 1) AS w FROM (SELECT *, unnest(generate_series(rare % 2, rare, 2)) AS h FROM tables)))
SELECT site, round(least(1.0, sum(CASE WHEN p <= own * (1 + 1e-7) THEN p ELSE 0 END) / sum(p)), 9) AS p FROM (SELECT *, max(CASE WHEN h = het THEN p END) OVER (PARTITION BY site) AS own FROM ways) GROUP BY site""",
    _PL,
)
def hwe_exact(spark, d):
    return variants.hwe_exact(variants.genotype_counts(P.likelihoods(spark, d))).withColumn("p", F.round("p", 9))


@query(
    """, tables AS (SELECT tid * 4294967296 + p AS site, count(*) FILTER (WHERE base = 'A' AND flag & 16 = 0) AS a, count(*) FILTER (WHERE base = 'A' AND flag & 16 <> 0) AS b, count(*) FILTER (WHERE base <> 'A' AND flag & 16 = 0) AS c, count(*) FILTER (WHERE base <> 'A' AND flag & 16 <> 0) AS d FROM pile GROUP BY tid, p),
ways AS (SELECT *, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(s + 1) + lgamma(n - s + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r - k + 1) - lgamma(s - k + 1) - lgamma(n - r - s + k + 1)) AS p
  FROM (SELECT *, unnest(generate_series(greatest(0, r + s - n), least(r, s))) AS k FROM (SELECT site, a, a + b AS r, a + c AS s, a + b + c + d AS n FROM tables)))
SELECT site, round(least(1.0, sum(CASE WHEN p <= own * (1 + 1e-7) THEN p ELSE 0 END)), 9) AS p FROM (SELECT *, max(CASE WHEN k = a THEN p END) OVER (PARTITION BY site) AS own FROM ways) GROUP BY site""",
    P.READS, _PILE,
)
def fisher_strand(spark, d):
    return _rounded(variants.strand_bias(_site_sums(P.reads(spark, d)).withColumn("site", F.shiftleft(F.col("tid").cast("long"), 32) + F.col("pos"))), "p")


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Columns rounded as DuckDB does: times a power of ten, to a whole number, and back. Spark rounds the decimal text, which differs next to ties."""
    unit = F.lit(10.0**digits)
    return df.withColumns({n: F.round(F.col(n) * unit) / unit for n in names})


#: Posterior of each number of second alleles, q.
_COUNTS = """, lik AS (SELECT site, list_transform(pl, lambda t: list_transform(t, lambda x: pow(10.0, -x / 10.0))) AS l FROM sites),
taken AS (SELECT site, 0 AS j, [1.0::DOUBLE] AS z, l FROM lik UNION ALL
  SELECT site, j + 1, list_transform(new, lambda x: x / greatest(list_max(new), 1e-300)), l FROM (SELECT site, j, l, list_transform(generate_series(0, 2 * (j + 1)), lambda k:
    ((2 * j + 2 - k) * (2 * j + 1 - k) * l[j + 1][1] * coalesce(z[k + 1], 0) + 2 * k * (2 * j + 2 - k) * l[j + 1][2] * CASE WHEN k > 0 THEN coalesce(z[k], 0) ELSE 0 END + k * (k - 1) * l[j + 1][3] * CASE WHEN k > 1 THEN coalesce(z[k - 1], 0) ELSE 0 END) / ((2 * j + 2) * (2 * j + 1))) AS new FROM taken WHERE j < len(l))),
post AS (SELECT site, list_transform(generate_series(0, 2 * j), lambda k: z[k + 1] * CASE WHEN k = 0 THEN greatest(1e-12, 1 - 0.001 * list_sum(list_transform(generate_series(1, 2 * j), lambda i: 1.0 / i))) ELSE 0.001 / k END) AS q FROM taken WHERE j = len(l))
"""


@query(
    _COUNTS + """SELECT site, round(q[1] / list_sum(q), 9) AS p_ref, round(list_sum(list_transform(generate_series(1, len(q)), lambda i: (i - 1) * q[i])) / list_sum(q), 9) AS ac FROM post""",
    _PL.replace("sites AS", "RECURSIVE sites AS", 1),
)
def allele_count_posterior(spark, d):
    return _rounded(variants.count_posterior(P.likelihoods(spark, d)), "p_ref", "ac")


@query(
    _COUNTS
    + """, cum AS (SELECT site, list_transform(generate_series(1, len(q)), lambda i: list_sum(q[1:i]) / list_sum(q)) AS c FROM post)
SELECT site, cast(len(list_filter(c, lambda x: x < 0.025)) AS int) AS low, cast(least(len(list_filter(c, lambda x: x < 0.975)), len(c) - 1) AS int) AS high FROM cum""",
    _PL.replace("sites AS", "RECURSIVE sites AS", 1),
)
def allele_count_interval(spark, d):
    return variants.count_interval(P.likelihoods(spark, d))


@query()
def group_contrast(spark, d):
    return variants.group_contrast(P.likelihoods(spark, d), 10)


@query(
    """, lik AS (SELECT site, list_transform(pl, lambda t: list_transform(t, lambda x: pow(10.0, -x / 10.0))) AS l FROM sites),
steps AS (SELECT site, 0 AS i, [1 / 3.0, 1 / 3.0, 1 / 3.0]::DOUBLE[] AS g, false AS rest, l FROM lik UNION ALL
  SELECT site, i + 1, new, list_max(list_transform(generate_series(1, 3), lambda k: abs(new[k] - g[k]))) < 1e-5, l FROM (SELECT site, i, g, l, list_transform(generate_series(1, 3), lambda k: list_avg(list_transform(l, lambda t: t[k] * g[k] / (t[1] * g[1] + t[2] * g[2] + t[3] * g[3])))) AS new FROM steps WHERE i < 50 AND NOT rest))
SELECT site, round(g[1], 6) AS g0, round(g[2], 6) AS g1, round(g[3], 6) AS g2 FROM (SELECT site, arg_max(g, i) AS g FROM steps GROUP BY site)""",
    _PL.replace("sites AS", "RECURSIVE sites AS", 1),
)
def genotype_em(spark, d):
    return _rounded(variants.genotype_em(P.likelihoods(spark, d)), "g0", "g1", "g2", digits=6)


@query(
    """, s AS (SELECT 'chr' || tid AS chrom, cast(b * 7 + rid % 7 AS bigint) AS pos, max(cast(rid % 60 AS int)) AS qual, max(rid % 9 = 0) AS is_indel FROM regions GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM s WHERE qual >= 10 AND is_indel),
walk AS (SELECT chrom, k, k AS last, pos AS at, qual AS q, cast(NULL AS bigint) AS gone FROM i WHERE k = 1 UNION ALL
  SELECT i.chrom, i.k, CASE WHEN i.pos - w.at > 10 OR i.qual > w.q THEN i.k ELSE w.last END, CASE WHEN i.pos - w.at > 10 OR i.qual > w.q THEN i.pos ELSE w.at END, CASE WHEN i.pos - w.at > 10 OR i.qual > w.q THEN i.qual ELSE w.q END,
    CASE WHEN i.pos - w.at > 10 THEN NULL WHEN i.qual > w.q THEN w.last ELSE i.k END FROM walk w JOIN i ON i.chrom = w.chrom AND i.k = w.k + 1),
kept AS (SELECT chrom, pos FROM i WHERE (chrom, k) NOT IN (SELECT (chrom, gone) FROM walk WHERE gone IS NOT NULL))
SELECT s.*, CASE WHEN qual < 10 THEN 'lowqual' WHEN is_indel THEN CASE WHEN (chrom, pos) IN (SELECT (chrom, pos) FROM kept) THEN 'PASS' ELSE 'indel_pair' END
  WHEN EXISTS (SELECT 1 FROM kept WHERE kept.chrom = s.chrom AND kept.pos BETWEEN s.pos - 3 AND s.pos + 3) THEN 'near_indel' ELSE 'PASS' END AS filter FROM s""",
    P.REGIONS.replace("regions AS", "RECURSIVE regions AS", 1),
)
def var_filter(spark, d):
    r = P.regions(spark, d).select(F.concat(F.lit("chr"), "tid").alias("chrom"), (F.col("b") * 7 + F.col("rid") % 7).cast("long").alias("pos"), (F.col("rid") % 60).cast("int").alias("qual"), (F.col("rid") % 9 == 0).alias("is_indel"))
    return variants.var_filter(r.groupBy("chrom", "pos").agg(F.max("qual").alias("qual"), F.max("is_indel").alias("is_indel")))


@query("SELECT CASE WHEN depth > 100 THEN 101 ELSE depth END::BIGINT AS bin, count(*) AS n FROM (" + _DEPTH + ") GROUP BY 1", P.READS)
def coverage_histogram(spark, d):
    return quality.coverage_histogram(depth.sweep(P.reads(spark, d), 10), hi=100)


@query("SELECT cast(mapq // 10 * 10 AS int) AS mapq, cast(sum(count(*)) OVER w AS bigint) AS n, cast(sum(count(*) FILTER (WHERE qid % 11 = 0)) OVER w AS bigint) AS wrong FROM reads GROUP BY mapq // 10 WINDOW w AS (ORDER BY mapq // 10 DESC)", P.READS)
def mapping_accuracy(spark, d):
    return sites.mapping_accuracy(P.reads(spark, d).select("mapq", (F.col("qid") % 11 == 0).alias("wrong")))


@query("SELECT DISTINCT g.tid, x.b, x.e FROM (SELECT 1) g0, (SELECT tid FROM regions GROUP BY tid) g, LATERAL (SELECT min(b) AS b, max(e) AS e FROM (SELECT b, e, sum(new) OVER (ORDER BY b, e) AS isl FROM (SELECT b, e, CASE WHEN b > max(e) OVER (ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM regions r WHERE r.tid = g.tid)) GROUP BY isl) x WHERE x.b IS NOT NULL", P.REGIONS)
def merged_regions(spark, d):
    return intervals.merged(P.regions(spark, d))


@query()
def ld_matrix(spark, d):
    return sites.linkage_matrix(P.likelihoods(spark, d))


@query()
def group_association(spark, d):
    return sites.association(P.likelihoods(spark, d), 10, rounds=10)


@query()
def site_bias(spark, d):
    return sites.bias_tests(_site_sums(P.reads(spark, d)))


@query(
    f""", deep AS ({_DEPTH.replace(" AND mapq >= 10", "")}),
cut AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY pos) AS isl FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY tid ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS fresh FROM deep)),
cells AS (SELECT tid, isl, pos, CASE WHEN depth >= 10 THEN 2 ELSE -2 END AS x, row_number() OVER (PARTITION BY tid, isl ORDER BY pos) AS k FROM cut),
walk AS (SELECT tid, isl, k, x AS d FROM cells WHERE k = 1 UNION ALL SELECT c.tid, c.isl, c.k, least(greatest(w.d, -2), 2) + c.x FROM walk w JOIN cells c ON c.tid = w.tid AND c.isl = w.isl AND c.k = w.k + 1),
sure AS (SELECT tid, isl, k, d, min(CASE WHEN abs(d) > 2 THEN k END) OVER (PARTITION BY tid, isl ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, max(k) OVER (PARTITION BY tid, isl) AS fin FROM walk),
path AS (SELECT s.tid, s.isl, s.k, e.d > 0 AS high FROM sure s JOIN walk e ON e.tid = s.tid AND e.isl = s.isl AND e.k = coalesce(s.nxt, s.fin)),
runs AS (SELECT p.tid, p.isl, c.pos, p.high, p.k - row_number() OVER (PARTITION BY p.tid, p.isl, p.high ORDER BY p.k) AS run FROM path p JOIN cells c USING (tid, isl, k))
SELECT 'chr' || tid AS chrom, cast(min(pos) AS bigint) AS beg, cast(max(pos) + 1 AS bigint) AS "end" FROM runs WHERE high GROUP BY tid, isl, run""",
    P.READS.replace("reads AS", "RECURSIVE reads AS", 1),
)
def target_segments(spark, d):
    return walks.two_state_segments(depth.sweep(P.reads(spark, d)).select(F.concat(F.lit("chr"), "tid").alias("chrom"), F.col("pos").cast("long").alias("pos"), "depth"), 10)


@query()
def call_sites(spark, d):
    return calling.call_sites(P.likelihoods(spark, d))


@query(
    """, free AS (SELECT site, pl, list_transform(pl[1:3], lambda t: list_position(t, list_min(t)) - 1) AS g, list_min(pl[1]) + list_min(pl[2]) + list_min(pl[3]) AS low FROM sites),
can AS (SELECT f, m, c FROM range(3) a(f), range(3) b(m), range(3) d(c) WHERE c BETWEEN (f = 2)::INT + (m = 2)::INT AND (f > 0)::INT + (m > 0)::INT),
bound AS (SELECT site, min({'s': pl[1][f + 1] + pl[2][m + 1] + pl[3][c + 1], 'f': f, 'm': m, 'c': c}) AS x FROM free, can GROUP BY site)
SELECT site, cast(CASE WHEN list_sum(g) = 0 THEN 0 ELSE x.s - low END AS int) AS clr, cast(g[1] + g[2] * 4 + g[3] * 16 AS int) AS ugt, cast(CASE WHEN list_sum(g) = 0 THEN 0 ELSE x.f + x.m * 4 + x.c * 16 END AS int) AS cgt FROM free JOIN bound USING (site)""",
    _PL,
)
def trio_llr(spark, d):
    return calling.pair_and_trio(P.likelihoods(spark, d))


@query()
def site_likelihoods(spark, d):
    return calling.site_likelihoods(_with_bases(depth.pileup_tiles(P.reads(spark, d))).withColumns({"ref": F.lit("A"), "sample": (F.col("qid") % 3).cast("int")}))


@query(
    """, q AS (SELECT tid, p AS pos, base, sum(baseq) AS q, count(*) AS n FROM pile GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY tid, pos ORDER BY q DESC, base DESC) AS k, sum(n) OVER (PARTITION BY tid, pos) AS d FROM q)
SELECT a.tid, a.pos, a.base, cast(least(a.q - coalesce(b.q, 0), 63) AS int) AS qual, cast(least(a.d, 255) AS int) AS depth FROM r a LEFT JOIN r b ON a.tid = b.tid AND a.pos = b.pos AND b.k = 2 WHERE a.k = 1""",
    P.READS, _PILE,
)
def haploid_consensus(spark, d):
    return calling.haploid_consensus(_with_bases(depth.pileup(P.reads(spark, d))))


@query()
def phase_sets(spark, d):
    return calling.phase_sets(_observations(spark, d))


def _observations(spark, d):
    """Letters of fragments at sites five apart; a fragment is what a template has within 50 positions."""
    r = P.reads(spark, d).select("tid", (F.col("qid") * 100 + F.floor((F.col("pos") + 2000) / 50)).alias("frag"), (F.col("pos") - F.pmod(F.col("pos"), F.lit(5))).alias("pos"), (F.col("mapq") % 2).alias("allele"))
    return r.groupBy("tid", "frag", "pos").agg(F.min("allele").alias("allele"))


#: Fragments of whole contigs at sites with a phase by rule: long enough for chimeras.
_SIDES = """obs AS (SELECT tid, qid // 16 AS frag, pos - ((pos % 5) + 5) % 5 AS pos, min(mapq % 2) AS allele FROM reads GROUP BY ALL),
sides AS (SELECT tid, frag, pos, allele, allele = ((pos // 5) % 3 = 0)::INT AS same FROM obs),
own AS (SELECT *, count(*) FILTER (WHERE same) OVER w AS n0, count(*) OVER w AS n FROM sides WINDOW w AS (PARTITION BY tid, frag)),
signed AS (SELECT *, CASE WHEN 2 * n0 > n THEN 0 ELSE 1 END AS phase, CASE WHEN 2 * n0 > n THEN n0 ELSE n - n0 END AS agree FROM own),
lefts AS (SELECT *, count(*) FILTER (WHERE same = (phase = 0)) OVER w AS l, count(*) OVER w AS k FROM signed WINDOW w AS (PARTITION BY tid, frag ORDER BY pos)),
worths AS (SELECT *, l + (n - k - (agree - l)) - 2 * (agree - l) AS t, k - l + (agree - l) - 2 * (n - k - (agree - l)) AS h FROM lefts),
frags AS (SELECT tid, frag, any_value(n) AS n, any_value(phase) AS phase, any_value(agree) AS agree, any_value(n) - any_value(agree) AS differ,
  max(greatest(t, h)) FILTER (WHERE k < n) AS w, arg_max({'p': pos, 't': t > h}, {'w': greatest(t, h), 'p': -pos}) FILTER (WHERE k < n) AS b FROM worths GROUP BY tid, frag),
cuts AS (SELECT *, least(agree, differ) >= 3 AND w - greatest(agree, differ) >= 4 AS is_cut FROM frags)"""


def _sided(spark, d):
    obs = P.reads(spark, d).select("tid", F.floor(F.col("qid") / 16).alias("frag"), (F.col("pos") - F.pmod(F.col("pos"), F.lit(5))).alias("pos"), (F.col("mapq") % 2).alias("allele")).groupBy("tid", "frag", "pos").agg(F.min("allele").alias("allele"))
    sites_ = obs.select("tid", "pos").distinct().select("tid", F.lit(0).alias("ps"), "pos", F.expr("CAST(pos DIV 5 % 3 = 0 AS int)").alias("phase"))
    return obs, sites_


@query("SELECT tid, frag, n, phase, agree, differ, agree <> differ AS phased, agree > 0 AND differ > 0 AND differ < 3 AND agree <= differ + 1 AS ambiguous, CASE WHEN is_cut THEN b.p END AS cut, CASE WHEN is_cut THEN b.t END AS tail FROM cuts", P.READS, _SIDES)
def fragment_phases(spark, d):
    return phasing.fragment_phases(*_sided(spark, d)).drop("ps")


@query(
    """, mended AS (SELECT o.tid, o.frag, o.pos, CASE WHEN c.is_cut AND (o.pos > c.b.p) = c.b.t THEN NOT o.same ELSE o.same END AS same FROM sides o JOIN cuts c USING (tid, frag)),
turned AS (SELECT tid, frag, CASE WHEN 2 * count(*) FILTER (WHERE same) > count(*) THEN 0 ELSE 1 END AS phase, count(*) AS n FROM mended GROUP BY tid, frag)
SELECT tid, pos, count(*) FILTER (WHERE n > 1 AND phase = 0 AND same) AS first_agree, count(*) FILTER (WHERE n > 1 AND phase = 0 AND NOT same) AS first_differ, count(*) FILTER (WHERE n > 1 AND phase = 1 AND NOT same) AS second_agree, count(*) FILTER (WHERE n > 1 AND phase = 1 AND same) AS second_differ
FROM mended JOIN turned USING (tid, frag) GROUP BY tid, pos""",
    P.READS, _SIDES,
)
def phase_support(spark, d):
    """Support of sites after chimeras were cut."""
    obs, at = _sided(spark, d)
    mended = phasing.repaired(obs, phasing.fragment_phases(obs, at))
    return phasing.site_support(mended, at, phasing.fragment_phases(mended, at, repair=False)).drop("ps")


@query()
def phase_masks(spark, d):
    """Stretches of sites where letters and sides do not fit."""
    obs, at = _sided(spark, d)
    return phasing.masked_regions(phasing.doubt(phasing.site_support(obs, at, phasing.fragment_phases(obs, at, repair=False)))).select("tid", "beg", "end", "score")


@query(
    "SELECT site, cast(sample AS int) AS sample, round(p[1] / list_sum(p), 6) AS l0, round(p[2] / list_sum(p), 6) AS l1, round(p[3] / list_sum(p), 6) AS l2 FROM (SELECT site, sample, list_transform(pl[sample + 1], lambda x: pow(10.0, -x / 10.0)) AS p FROM (SELECT site, pl, unnest(generate_series(0, 21)) AS sample FROM sites))",
    _PL,
)
def beagle_likelihoods(spark, d):
    return sites.beagle_likelihoods(P.likelihoods(spark, d))


@query("SELECT pos, rid, count(*) OVER (PARTITION BY tid ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) > 4 AS dense FROM (SELECT tid, rid, b * 7 + cast(rid % 7 AS int) AS pos FROM regions)", P.REGIONS)
def snp_density(spark, d):
    r = P.regions(spark, d).select(F.col("tid").alias("chrom"), "rid", (F.col("b") * 7 + (F.col("rid") % 7).cast("int")).alias("pos"))
    return sites.snp_density(r, 10, 4).select("pos", "rid", "dense")


_TEN = ", ".join(f"'{x}{y}'" for j, y in enumerate("ACGT") for x in "ACGT"[: j + 1])


@query(
    f"""SELECT 's' || (i - 1) || chr(9) || 'chr' || (site % 3) || chr(9) || (site + 1) || chr(9) || r || chr(9) || array_to_string(list_transform([{_TEN}], lambda g:
CASE WHEN g = r || r THEN pl[i][1] WHEN g IN (r || b, b || r) THEN pl[i][2] WHEN g = b || b THEN pl[i][3] ELSE 255 END), chr(9)) AS value
FROM (SELECT *, unnest(generate_series(1, 22)) AS i, substr('ACGT', cast(site % 4 + 1 AS int), 1) AS r, substr('ACGT', cast((site + 1) % 4 + 1 AS int), 1) AS b FROM sites)""",
    _PL,
)
def ten_likelihoods(spark, d):
    """Lines of the ten genotypes of each sample at each site."""
    s = P.likelihoods(spark, d).selectExpr(
        "concat('chr', site % 3) AS chrom", "CAST(site AS int) AS pos", "substring('ACGT', CAST(site % 4 + 1 AS int), 1) AS ref", "array(substring('ACGT', CAST((site + 1) % 4 + 1 AS int), 1)) AS alt",
        "transform(pl, x -> map('PL', array_join(transform(x, v -> CAST(v AS string)), ','))) AS samples",
    )
    return sites.qcall_lines(s, [f"s{k}" for k in range(22)])


@query("SELECT site, array_to_string(list_transform(gl, lambda x: cast(least(255, round(-10 * (x - list_max(gl)))) AS int)), ',') AS pl FROM (SELECT site, list_transform(flatten(pl), lambda v: v * -0.137) AS gl FROM sites)", _PL)
def likelihoods_scaled(spark, d):
    """Likelihoods as logarithms, brought back to whole numbers from the best one on."""
    s = P.likelihoods(spark, d).select("site", F.transform(F.flatten("pl"), lambda v: v * F.lit(-0.137)).alias("gl"))
    return sites.likelihood_to_pl(s).select("site", F.array_join(F.col("pl").cast("array<string>"), ",").alias("pl"))
