"""The same statistics over a stream of reads: counters and depth as streaming aggregates, duplicates by a bounded state.

A stream of aligned reads has no event time of its own; ``seen_at`` (the time a read arrived) carries the
watermark after which a duplicate is no longer looked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import any_of, none_of
from ..model import PILEUP_SKIP
from ..operators.records import flagstat


def stream_flagstat(reads: DataFrame) -> DataFrame:
    """Running flag counters; write with output mode complete or update."""
    return flagstat(reads)


def stream_depth(reads: DataFrame) -> DataFrame:
    """Running depth per position of the reads seen so far."""
    r = reads.where(none_of("flag", PILEUP_SKIP) & (F.col("e") > F.col("pos")))
    return r.select("tid", F.explode(F.sequence(F.col("pos"), F.col("e") - 1)).alias("pos")).groupBy("tid", "pos").agg(F.count(F.lit(1)).alias("depth"))


def stream_first_of_duplicates(reads: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first read of each (contig, strand, 5' end) within the watermark; state older than ``delay`` is dropped."""
    rev = any_of("flag", 16)
    keyed = reads.withColumns({"_rev": rev, "_key": F.when(rev, F.col("e")).otherwise(F.col("pos"))}).withWatermark("seen_at", delay)
    return keyed.dropDuplicatesWithinWatermark(["tid", "_rev", "_key"]).drop("_rev", "_key")


def stream_windows(reads: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Reads and mean mapping quality by contig and window of arrival."""
    return reads.withWatermark("seen_at", delay).groupBy(F.window("seen_at", width), "tid").agg(F.count(F.lit(1)).alias("n"), F.avg("mapq").alias("mapq"))
