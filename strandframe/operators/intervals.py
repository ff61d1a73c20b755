"""Interval operators: binned overlap joins, region fetch, coverage sums without a join of rows.

A bare overlap condition plans as a nested loop. Both sides are dealt to the bins they touch and joined on
(key, bin); a pair is kept only in the bin where the later of the two starts lies, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sweep import tiled_cumsum, tiled_max, tiled_next

BIN = 64
#: Regions, once for each bin that they touch, that are sent to all tasks.
BROADCAST_ROWS = 100_000


def _binned(df: DataFrame, beg: str, end: str, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col(beg) / width), F.floor((F.col(end) - 1) / width))
    return df.where(F.col(end) > F.col(beg)).withColumn("_bin", F.explode(bins))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "tid", l_beg="pos", l_end="e", r_beg="b", r_end="re", width: int = BIN, small: bool = False) -> DataFrame:
    """Inner join of half-open intervals; every overlapping pair once. Right columns must not clash but for the key. A ``small`` right side is
    broadcast, so the left one is not shuffled."""
    a = _binned(left, l_beg, l_end, width)
    b = _binned(right.withColumnRenamed(key, "_rkey"), r_beg, r_end, width).withColumnRenamed("_bin", "_rbin")
    on = (F.col(key) == F.col("_rkey")) & (F.col("_bin") == F.col("_rbin"))
    pairs = a.join(F.broadcast(b) if small else b, on).where((F.col(l_beg) < F.col(r_end)) & (F.col(r_beg) < F.col(l_end)))
    first = F.floor(F.greatest(F.col(l_beg), F.col(r_beg)) / width)
    return pairs.where(F.col("_bin") == first).drop("_bin", "_rbin", "_rkey")


def merged(regions: DataFrame, key: str = "tid", beg: str = "b", end: str = "e") -> DataFrame:
    """Union of intervals per key, as disjoint intervals (key, b, e)."""
    ev = regions.where(F.col(end) > F.col(beg)).select(key, F.explode(F.array(F.struct(F.col(beg).alias("p"), F.lit(1).alias("d")), F.struct(F.col(end).alias("p"), F.lit(-1).alias("d")))).alias("_v"))
    ev = ev.select(key, F.col("_v.p").alias("p"), F.col("_v.d").alias("d")).groupBy(key, "p").agg(F.sum("d").alias("d"))
    cum = tiled_cumsum(ev, [key], "p", ["d"])
    edges = cum.withColumn("was", F.col("cum_d") - F.col("d")).where(((F.col("was") == 0) & (F.col("cum_d") > 0)) | ((F.col("was") > 0) & (F.col("cum_d") == 0)))
    return tiled_next(edges, [key], "p", "e").where(F.col("was") == 0).select(key, F.col("p").alias("b"), "e")


def overlap_semi(left: DataFrame, regions: DataFrame, key: str = "tid", beg="pos", end="e", width: int = 1 << 12) -> DataFrame:
    """Rows of ``left`` that overlap any region.

    Regions are merged, and each bin holds the merged regions that reach into it plus the next one after it
    (at most width / 2 + 1). A row then asks only the bin of its start: one equi-join, no explode, no distinct.
    """
    m = tiled_max(merged(regions, key), [key], "b", F.col("e"), "_prev", inclusive=False).withColumn("_prev", F.coalesce("_prev", F.lit(0)))
    bins = F.sequence(F.floor(F.col("_prev") / width), F.floor((F.col("e") - 1) / width))
    m = m.select(F.col(key).alias("_rk"), F.explode(bins).alias("_rbin"), F.struct("b", "e").alias("_r"))
    touched = m.groupBy("_rk", "_rbin").agg(F.collect_list("_r").alias("_in"))
    rows = left.where(F.col(end) > F.col(beg))
    out = rows.join(touched, (F.col(key) == F.col("_rk")) & (F.floor(F.col(beg) / width) == F.col("_rbin")))
    return out.where(F.exists("_in", lambda r: (r["b"] < F.col(end)) & (F.col(beg) < r["e"]))).select(*left.columns)


def region_fetch(reads: DataFrame, tid: int, beg: int, end: int) -> DataFrame:
    """Reads that overlap [beg, end) of one contig: a range predicate that reaches the scan."""
    stop = F.greatest(F.col("e"), F.col("pos") + 1)
    return reads.where((F.col("tid") == tid) & (F.col("pos") < end) & (stop > beg))


def fetch_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """A row for each (region, read) that overlap: a read is returned once per region. Regions are counted first, by the bins that they touch;
    up to ``BROADCAST_ROWS`` of these go to the reads, which then are neither shuffled nor sorted."""
    bins = F.floor((F.col("e") - 1) / BIN) - F.floor(F.col("b") / BIN) + 1
    n = regions.where("e > b").agg(F.sum(bins)).first()[0] or 0
    return overlap_join(reads, regions.withColumnRenamed("e", "re"), small=n <= BROADCAST_ROWS)


def coverage(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """(rid, cov): summed raw depth of each region, 0 where none.

    With F(x) the covered bases left of x, a region has F(e) - F(b), and F(x) follows from running counts and sums
    of starts and ends. Reads and regions never meet as pairs, so deep coverage costs nothing extra.
    """
    ev = reads.select("tid", F.explode(F.array(F.struct(F.col("pos").alias("x"), F.lit(1).alias("n")), F.struct(F.col("e").alias("x"), F.lit(-1).alias("n")))).alias("v"))
    ev = ev.select("tid", F.col("v.x").alias("x"), F.col("v.n").cast("long").alias("n"), (F.col("v.x") * F.col("v.n")).cast("long").alias("s"))
    ask = regions.select("tid", F.explode(F.array("b", "e")).alias("x"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    pts = ev.unionByName(ask).groupBy("tid", "x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    f = tiled_cumsum(pts, ["tid"], "x", ["n", "s"]).select("tid", "x", (F.col("x") * F.col("cum_n") - F.col("cum_s")).alias("f"))
    at = regions.join(f.select("tid", F.col("x").alias("b"), F.col("f").alias("fb")), ["tid", "b"]).join(f.select("tid", F.col("x").alias("e"), F.col("f").alias("fe")), ["tid", "e"])
    return at.select("rid", "tid", "b", "e", (F.col("fe") - F.col("fb")).cast("long").alias("cov"))


def tiles(regions: DataFrame, length: int) -> DataFrame:
    """Cut intervals into tiles of ``length``; the last may be up to 1.1 times as long."""
    n = F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("b")) / F.lit(length) - 0.1)).cast("int")
    t = regions.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    beg = F.col("b") + F.col("_k") * length
    return t.select("rid", "tid", beg.alias("tb"), F.when(F.col("_k") == F.col("_n") - 1, F.col("e")).otherwise(beg + length).alias("te"))
