"""Consensus of aligned reads against a reference, by order-independent winners per position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import none_of, packed_rank
from ..model import CONSENSUS_SKIP
from .tiles import expand, reference_tiles, slices


def with_ranks(reads: DataFrame) -> DataFrame:
    """Adds what ``winner`` compares, once a read instead of once a base."""
    first, best = packed_rank(F.lit(0), "ord") * 65536 + F.col("mapq"), F.when(F.col("mapq") != 255, packed_rank("mapq", "ord") * 256)
    return reads.withColumns({"_first": first.cast("decimal(37,0)"), "_best": best.cast("decimal(37,0)")})


def winner(reads_at: DataFrame, key=("tid", "pos")) -> DataFrame:
    """(key, base, mapq): a later read replaces the winner only by a strictly greater MAPQ that is not 255.

    Needs ord, mapq, base (a letter); ``with_ranks`` before bases are taken apart saves time. The fold in arrival order equals: the
    first read wins if its MAPQ is 255; else the greatest MAPQ among the first and those other than 255, the earliest on ties. Both are
    maxima of packed numbers, so a hash aggregate with map-side combine, no sort."""
    rows = reads_at if "_first" in reads_at.columns else with_ranks(reads_at)
    letter = F.ascii("base")
    g = rows.groupBy(*key).agg(F.max(F.col("_first") + letter * 256).alias("f"), F.max(F.col("_best") + letter).alias("b"))
    low = lambda x: F.pmod(x, F.lit(256)).cast("int")
    f_mapq, f_letter = low(F.col("f")), low(F.expr("(f - pmod(f, 256)) / 256"))
    b_mapq = F.floor(F.col("b") / F.expr("4722366482869645213696BD")).cast("int")  # 2^72
    take_first = (f_mapq == 255) | F.col("b").isNull()
    return g.select(*key, F.char(F.when(take_first, f_letter).otherwise(low(F.col("b")))).alias("base"), F.when(take_first, f_mapq).otherwise(b_mapq).alias("mapq"))


def insertion_winner(insertions: DataFrame, key=("tid", "pos")) -> DataFrame:
    """(key, ins, mapq): the greatest MAPQ wins, the earliest on ties; here 255 counts like any value."""
    return insertions.groupBy(*key).agg(F.max_by(F.struct("ins", "mapq"), F.struct(F.col("mapq"), (-F.col("ord")).alias("o"))).alias("x")).select(*key, "x.ins", "x.mapq")


def usable(reads: DataFrame) -> DataFrame:
    return reads.where(none_of("flag", CONSENSUS_SKIP))


#: Bases that are taken apart at once.
PART = 1_000_000


def _candidates(batches):
    """Of the bases over each position in a part of the reads those that may win: that of the first read, and that of the greatest MAPQ but 255."""
    for reads in _gathered(batches):
        x = expand(reads)
        rows = np.flatnonzero(~x["is_refskip"])
        names = pc.dictionary_encode(reads.column("rname").combine_chunks(), null_encoding="encode")
        read = x["read"][rows]
        place = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[read] << 32 | (x["p"][rows] & 0xFFFFFFFF)
        at, back = np.unique(place, return_inverse=True)
        order, mapq = (reads.column(k).to_numpy() for k in ("ord", "mapq"))
        early, good, never = np.empty(len(order), np.int64), np.empty(len(order), np.int64), 1 << 62
        early[np.argsort(order, kind="stable")] = good[np.lexsort((order, -mapq.astype(np.int64)))] = np.arange(len(order))
        picks = []
        for rank in (early[read] << 32 | np.arange(len(rows)), np.where(mapq[read] == 255, never, good[read] << 32 | np.arange(len(rows)))):
            least = np.full(len(at), never)
            np.minimum.at(least, back, rank)
            picks.append(least[least < never] & 0xFFFFFFFF)
        own = np.unique(np.concatenate(picks))
        letter = x["base"][rows][own] & 0xDF
        letter = np.where(x["is_del"][rows][own], ord("-"), np.where(np.isin(letter, list(b"ACGT")), letter, ord("N"))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [names.dictionary.take(names.indices.take(pa.array(read[own]))), pa.array(x["p"][rows][own].astype(np.int32)), pa.array(order[read[own]].astype(np.int64)), pa.array(mapq[read[own]].astype(np.int32)), pa.array(letter.view("S1").astype(str).tolist(), pa.string())],
            ["rname", "pos", "ord", "mapq", "base"],
        )


def _gathered(batches):
    """Tables of about ``PART`` bases from batches of reads."""
    held, size = [], 0
    for x in (x for b in batches for x in slices(b, PART)):
        held.append(x)
        size += pc.sum(pc.binary_length(x.column("seq"))).as_py() or 0
        if size >= PART:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def bases_and_insertions(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions and insertions of reads with a CIGAR; N never writes, D writes a gap; other letters become N. Of the bases over a position
    a task gives those only that may win among its own reads (see ``winner``), so no base is shuffled that cannot."""
    from ..functions.reads import aligned_blocks

    r = usable(reads).where(F.size("cigar") > 0)
    m = r.select("rname", "pos", F.col("ord").cast("long").alias("ord"), "mapq", "cigar", "seq", F.lit("").alias("qual")).mapInArrow(_candidates, "rname string, pos int, ord long, mapq int, base string")
    own = F.exists("cigar", lambda x: x["op"] == "I")
    r = r.where(own).withColumn("x", F.explode(aligned_blocks("pos", "cigar", "I")))
    ins = r.select("rname", F.col("x.rbeg").alias("pos"), "ord", "mapq", F.regexp_replace(F.upper(F.substring("seq", F.col("x.qbeg") + 1, F.col("x.len"))), "[^ACGT]", "N").alias("ins"))
    return m, ins


def pairwise(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """(rname, ref_aln, seq_aln): padded reference and consensus; reference is (name, seq). One contig's columns are
    ordered in pieces of 4096 positions, then the pieces are joined."""
    m, ins = bases_and_insertions(reads)
    base = winner(m, ("rname", "pos"))
    extra = insertion_winner(ins, ("rname", "pos"))
    tiles = reference_tiles(reference, 0, 4096).select("rname", F.struct(F.col("_tile").alias("t"), F.col("_ref").alias("s")).alias("x"))
    cols = tiles.select("rname", F.posexplode(F.split("x.s", "")).alias("i", "r"), "x.t").where("r <> ''").select("rname", (F.col("t") * 4096 + F.col("i")).alias("pos"), "r")
    j = cols.join(base, ["rname", "pos"], "left").join(extra.select("rname", "pos", "ins"), ["rname", "pos"], "left")
    gap = F.coalesce(F.col("ins"), F.lit(""))
    j = j.select("rname", "pos", F.concat(F.repeat(F.lit("-"), F.length(gap)), F.col("r")).alias("a"), F.concat(gap, F.coalesce("base", F.lit("N"))).alias("b"), F.floor(F.col("pos") / 4096).alias("t"))
    piece = j.groupBy("rname", "t").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("xs"))
    piece = piece.select("rname", "t", F.array_join(F.transform("xs", lambda x: x["a"]), "").alias("a"), F.array_join(F.transform("xs", lambda x: x["b"]), "").alias("b"))
    whole = piece.groupBy("rname").agg(F.array_sort(F.collect_list(F.struct("t", "a", "b"))).alias("xs"))
    return whole.select("rname", F.array_join(F.transform("xs", lambda x: x["a"]), "").alias("ref_aln"), F.array_join(F.transform("xs", lambda x: x["b"]), "").alias("seq_aln"))
