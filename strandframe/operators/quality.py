"""Sections of alignment statistics: each is one grouped aggregate over reads with sequence and qualities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import any_of, none_of, span


def primary(reads: DataFrame) -> DataFrame:
    return reads.where(none_of("flag", 0x100 | 0x800))


def summary(reads: DataFrame) -> DataFrame:
    """One row of totals: sequences, bases, mapped, paired, duplicates, bases mapped by CIGAR, error-free lengths and means."""
    n = F.length("seq")
    m = none_of("flag", 4)
    return primary(reads).agg(
        F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("bases"), F.max(n).alias("longest"), F.count_if(m).alias("mapped"),
        F.count_if(~m).alias("unmapped"), F.count_if(m & (F.col("mapq") == 0)).alias("mapq0"), F.count_if(any_of("flag", 1)).alias("paired"), F.count_if(any_of("flag", 1024)).alias("duplicates"),
        F.coalesce(F.sum(F.when(m, span("cigar", "MI=X"))), F.lit(0)).cast("long").alias("bases_mapped_cigar"), F.round(F.avg(n), 6).alias("mean_length"),
    )


def quality_by_cycle(reads: DataFrame) -> DataFrame:
    """(read, cycle, qual, n): cycles count in the order of sequencing, so reverse reads are turned."""
    q = F.split("qual", "")
    q = F.filter(q, lambda x: x != "")
    q = F.when(any_of("flag", 16), F.reverse(q)).otherwise(q)
    r = primary(reads).where(F.col("qual").isNotNull()).select(F.when(any_of("flag", 128), 2).otherwise(1).alias("read"), F.posexplode(q).alias("cycle", "q"))
    return r.groupBy("read", "cycle", (F.ascii("q") - 33).alias("qual")).agg(F.count(F.lit(1)).alias("n"))


def gc_histogram(reads: DataFrame, bins: int = 100) -> DataFrame:
    """(gc, n): reads by share of G and C."""
    s = F.upper("seq")
    gc = F.length(F.regexp_replace(s, "[^GC]", ""))
    return primary(reads).where(F.length("seq") > 0).groupBy(F.floor(gc * bins / F.length("seq")).cast("int").alias("gc")).agg(F.count(F.lit(1)).alias("n"))


def base_by_cycle(reads: DataFrame) -> DataFrame:
    """(cycle, base, n)."""
    s = F.filter(F.split(F.upper("seq"), ""), lambda x: x != "")
    s = F.when(any_of("flag", 16), F.reverse(F.transform(s, lambda x: F.translate(x, "ACGT", "TGCA")))).otherwise(s)
    return primary(reads).where(F.length("seq") > 0).select(F.posexplode(s).alias("cycle", "base")).groupBy("cycle", "base").agg(F.count(F.lit(1)).alias("n"))


def read_lengths(reads: DataFrame) -> DataFrame:
    return primary(reads).groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def indel_lengths(reads: DataFrame) -> DataFrame:
    """(len, insertions, deletions)."""
    c = primary(reads).where(none_of("flag", 4)).select(F.explode("cigar").alias("c")).where(F.col("c.op").isin("I", "D"))
    return c.groupBy(F.col("c.len").alias("len")).agg(F.count_if(F.col("c.op") == "I").alias("insertions"), F.count_if(F.col("c.op") == "D").alias("deletions"))


def coverage_histogram(depths: DataFrame, lo: int = 1, hi: int = 1000, step: int = 1) -> DataFrame:
    """(bin, n): positions by depth, in steps; what lies beyond ``hi`` falls into one last bin."""
    b = F.when(F.col("depth") > hi, hi + step).otherwise(F.floor((F.col("depth") - lo) / step) * step + lo)
    return depths.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def indels_by_homopolymer(indels: DataFrame) -> DataFrame:
    """(rg, run, ins, del): one-base indels per read group by the length of the homopolymer at the site (rg, len, run)."""
    one = indels.where(F.abs("len") == 1)
    return one.groupBy("rg", "run").agg(F.count_if(F.col("len") == 1).alias("ins"), F.count_if(F.col("len") == -1).alias("del"))
