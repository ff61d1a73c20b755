"""Filters, counts, order and duplicates of aligned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import any_of, has, none_of, order_of, packed_rank, pair_orientation, x31
from .intervals import overlap_semi
from .sweep import tiled_rank


def view(reads, min_mapq=0, require=0, exclude=0, min_query=0, regions=None, read_groups=None, libraries=None, header=None, fraction=None, seed=0, name="qid") -> DataFrame:
    """Record filter. ``require`` asks for all bits. Untagged records pass a read-group filter. ``fraction`` keeps whole
    templates by a hash of the name. ``libraries`` needs ``header`` (rg, lb). ``regions`` keeps what overlaps any."""
    r = reads
    if min_query:
        r = r.where(F.col("qlen") >= min_query)
    r = r.where((F.col("mapq") >= min_mapq) & has("flag", require) & none_of("flag", exclude))
    if fraction is not None:
        r = r.where(F.pmod(x31(F.col(name).cast("string")) + seed, F.lit(1 << 24)) / float(1 << 24) < fraction)
    if read_groups is not None:
        r = r.where(F.col("rg").isNull() | F.col("rg").isin(*read_groups))
    if libraries is not None:
        r = r.join(F.broadcast(header.where(F.col("lb").isin(*libraries)).select("rg")), "rg", "left_semi")
    return overlap_semi(r, regions) if regions is not None else r


def pileup_filter(reads, require_any=0, exclude=0, min_mapq=0, keep_orphans=False) -> DataFrame:
    """Read filter of pileup: ``require_any`` asks for *any* bit; orphans are paired reads that are not proper."""
    r = reads.where(none_of("flag", 4 | exclude) & (F.col("mapq") >= min_mapq))
    if require_any:
        r = r.where(any_of("flag", require_any))
    return r if keep_orphans else r.where(none_of("flag", 1) | has("flag", 2))


def flagstat(reads: DataFrame) -> DataFrame:
    """Eleven counters by QC outcome."""
    paired, mapped = any_of("flag", 1), none_of("flag", 4)
    both = paired & mapped & none_of("flag", 8)
    far = both & (F.col("mtid") != F.col("tid"))
    agg = {
        "total": F.lit(True), "dup": any_of("flag", 1024), "mapped": mapped, "paired": paired, "read1": paired & any_of("flag", 64), "read2": paired & any_of("flag", 128),
        "proper": paired & has("flag", 2), "both_mapped": both, "singletons": paired & mapped & any_of("flag", 8), "diff_chr": far, "diff_chr_q5": far & (F.col("mapq") >= 5),
    }
    return reads.groupBy(any_of("flag", 512).alias("qcfail")).agg(*[F.count_if(x).alias(k) for k, x in agg.items()])


def idxstats(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per contig: length, mapped and unmapped placed reads; contigs without reads have 0; ``*`` holds the unplaced."""
    g = reads.groupBy("tid").agg(F.count_if(none_of("flag", 4)).alias("mapped"), F.count_if(any_of("flag", 4)).alias("unmapped"))
    known = F.broadcast(contigs).join(g, "tid", "left").select("name", "len", F.coalesce("mapped", F.lit(0)).cast("long").alias("mapped"), F.coalesce("unmapped", F.lit(0)).cast("long").alias("unmapped"))
    loose = reads.where("tid < 0").agg(F.count(F.lit(1)).alias("unmapped"))
    return known.unionByName(loose.select(F.lit("*").alias("name"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("mapped"), "unmapped"))


def coordinate_order() -> list:
    """Unplaced last, position, strand, arrival."""
    return [F.col("tid") < 0, F.col("tid"), F.col("pos"), any_of("flag", 16), F.col("ord")]


def coordinate_rank(reads: DataFrame, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each read within its contig in coordinate order, without a task that holds a contig."""
    return tiled_rank(reads, ["tid"], "pos", [any_of("flag", 16), F.col("ord")], name)


def coordinate_sort(reads: DataFrame) -> DataFrame:
    return reads.orderBy(*coordinate_order())


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """Files of one header, one after the other; rows are not sorted."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_sorted(*inputs: DataFrame) -> DataFrame:
    """k-way merge: by coordinate, then input, then arrival. Adds ``file``."""
    out = None
    for k, x in enumerate(inputs):
        part = x.withColumn("file", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.col("tid") < 0, "tid", "pos", any_of("flag", 16), "file", "ord")


def bucket_shuffle(reads: DataFrame, n: int, name: str = "qid") -> DataFrame:
    """Deal reads to ``n`` buckets by name hash, mates together, ordered by (hash, name, read number) inside."""
    h = reads.withColumn("hash", x31(F.col(name).cast("string"))).withColumn("bucket", F.pmod(F.col("hash"), F.lit(n)).cast("int"))
    return h.repartition("bucket").sortWithinPartitions("bucket", "hash", name, F.col("flag").bitwiseAND(0xC0), "ord")


def rmdup_single(reads: DataFrame, score: str = "mapq") -> DataFrame:
    """Of single reads of one (contig, strand, 5' end) the one of the highest score stays, the first on ties."""
    rev = any_of("flag", 16)
    key = F.when(rev, F.col("e")).otherwise(F.col("pos"))
    r = reads.withColumns({"_rev": rev, "_key": key})
    keep = r.groupBy("tid", "_rev", "_key").agg(F.max(packed_rank(F.col(score), F.col("ord"))).alias("_b")).select("tid", "_rev", "_key", order_of("_b").alias("ord"))
    return r.join(keep, ["tid", "_rev", "_key", "ord"], "left_semi").select(*reads.columns)


def rmdup_pair(pairs: DataFrame, key=("lib", "tid", "pos", "isize"), score: str = "score") -> DataFrame:
    """Of pairs with equal (library, contig, position, insert size) the highest score stays, the first on ties."""
    keep = pairs.groupBy(*key).agg(F.max(packed_rank(F.col(score), F.col("ord"))).alias("_b")).withColumn("_keep", order_of("_b"))
    return pairs.join(keep.select(*[F.col(k).alias(f"_{k}") for k in key], "_keep"), [pairs[k].eqNullSafe(F.col(f"_{k}")) for k in key] + [F.col("ord") == F.col("_keep")], "left_semi")


def best_hit(reads: DataFrame, name: str = "qid", score: str = "mapq") -> DataFrame:
    """Per read name the hit of the highest score, with MAPQ 250 * (max - second) / max. Two maxima are one aggregate."""
    g = reads.groupBy(name).agg(F.max(packed_rank(F.col(score), F.col("ord"))).alias("_m"), F.count(F.lit(1)).alias("hits"))
    r = reads.join(g, name).withColumn("_top", F.col("ord") == order_of("_m"))
    second = r.where(~F.col("_top")).groupBy(name).agg(F.max(score).alias("_second"))
    top = r.where("_top").join(second, name, "left")
    m, s = F.col(score).cast("double"), F.coalesce(F.col("_second"), F.lit(0)).cast("double")
    return top.select(name, "ord", F.col(score).alias("best"), F.when(m > 0, F.floor(250 * (m - s) / m)).otherwise(0).cast("int").alias("new_mapq"), "hits")


def fixmate(reads: DataFrame, name: str = "qid") -> DataFrame:
    """Fill mate fields of neighbours in a run of one name (column ``ord`` is the order of the run).

    Reads pair greedily, two by two; an odd last one loses its mate. Mate flags are set from the mate; proper
    pair is cleared when either is unmapped. Adds mtid, mpos, isize; secondary reads should be kept apart."""
    w = Window.partitionBy(name).orderBy("ord")
    r = reads.withColumn("_k", F.row_number().over(w) - 1)
    odd = F.col("_k") % 2 == 1
    mate = F.when(odd, F.lag(F.struct("tid", "pos", "e", "flag")).over(w)).otherwise(F.lead(F.struct("tid", "pos", "e", "flag")).over(w))
    r = r.withColumn("_m", mate)
    five = lambda flag, pos, end: F.when(any_of(flag, 16), end).otherwise(pos)
    own5, mate5 = five(F.col("flag"), F.col("pos"), F.col("e")), five(F.col("_m.flag"), F.col("_m.pos"), F.col("_m.e"))
    paired = F.col("_m").isNotNull()
    unmapped = any_of("flag", 4) | any_of(F.col("_m.flag"), 4)
    base = F.col("flag").bitwiseAND(~(8 | 32))
    flag = base.bitwiseOR(F.when(any_of(F.col("_m.flag"), 4), 8).otherwise(0)).bitwiseOR(F.when(any_of(F.col("_m.flag"), 16), 32).otherwise(0))
    flag = F.when(unmapped, flag.bitwiseAND(~2)).otherwise(flag)
    size = F.when(~unmapped & (F.col("tid") == F.col("_m.tid")), mate5 - own5).otherwise(0)
    return r.select(
        name, "ord", "tid", "pos",
        F.when(paired, flag).otherwise(F.col("flag").bitwiseAND(~(1 | 2 | 8 | 32))).cast("int").alias("flag"),
        F.when(paired, F.col("_m.tid")).otherwise(-1).alias("mtid"), F.when(paired, F.col("_m.pos")).otherwise(-1).alias("mpos"), F.when(paired, size).otherwise(0).cast("int").alias("isize"),
    )


def compare_reads(a: DataFrame, b: DataFrame, name: str = "qid", within: int = 0) -> DataFrame:
    """Outcome classes of two mappings of the same reads (one row a name on either side), with counts."""
    x = a.select(name, F.col("tid").alias("t1"), F.col("pos").alias("p1"), F.col("mapq").alias("q1"))
    y = b.select(name, F.col("tid").alias("t2"), F.col("pos").alias("p2"), F.col("mapq").alias("q2"))
    j = x.join(y, name, "full_outer")
    same = (F.col("t1") == F.col("t2")) & (F.abs(F.col("p1") - F.col("p2")) <= within)
    cls = F.when(F.col("t2").isNull(), "only_first").when(F.col("t1").isNull(), "only_second").when(same, "same").when(F.col("q1") > F.col("q2"), "first_better").when(F.col("q1") < F.col("q2"), "second_better").otherwise("undecided")
    return j.groupBy(cls.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def insert_sizes(pairs: DataFrame, top: int = 8000) -> DataFrame:
    """(isize, inward, outward, other) counts of pairs (flag, pos, pnext, isize)."""
    p = pairs.withColumn("o", pair_orientation("flag", "pos", "pnext")).withColumn("isize", F.least(F.abs("isize"), F.lit(top)))
    return p.groupBy("isize").agg(*[F.count_if(F.col("o") == k).alias(k) for k in ("inward", "outward", "other")])
