"""Statistics of sequences: composition, GC by position, homopolymers, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def base_composition(sequences: DataFrame) -> DataFrame:
    """(base, n) over all sequences: counted inside each row, so one partial row a base and task is shuffled."""
    n = F.length("seqs")
    each = sequences.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), (n - F.length(F.replace("seqs", F.lit(b), F.lit("")))).cast("long").alias("n")) for b in "ACGTN"])).alias("x"))
    return each.groupBy("x.base").agg(F.sum("x.n").cast("long").alias("n"))


def gc_by_cycle(sequences: DataFrame, cycles: int | None = None) -> DataFrame:
    """(cycle, gc, total) of all positions, or of the first ``cycles``."""
    head = sequences.select(F.split(F.substring("seqs", 1, cycles) if cycles else F.col("seqs"), "").alias("x"))
    rows = head.select(F.posexplode("x").alias("cycle", "b")).where("b <> ''")
    return rows.groupBy("cycle").agg(F.count_if(F.col("b").isin("G", "C")).alias("gc"), F.count(F.lit(1)).alias("total"))


def homopolymer_runs(sequences: DataFrame, least: int = 3) -> DataFrame:
    """(base, len, n): runs of one base of at least ``least``; found by one regular expression in each row."""
    runs = F.regexp_extract_all("seqs", F.lit(f"((?:A{{{least},}})|(?:C{{{least},}})|(?:G{{{least},}})|(?:T{{{least},}}))"), F.lit(1))
    return sequences.select(F.explode(runs).alias("r")).groupBy(F.left("r", F.lit(1)).alias("base"), F.length("r").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def sequence_digests(sequences: DataFrame) -> DataFrame:
    """(seq, md5) of the letters, upper case."""
    return sequences.select("seq", F.md5(F.upper(F.regexp_replace("seqs", "[^A-Za-z]", ""))).alias("md5"))
