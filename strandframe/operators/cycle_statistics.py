"""Sections of alignment statistics that need the reference or positions along the contigs: mismatches and gaps by cycle, depth by share of G and C."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import none_of
from .quality import primary
from .sites import with_reference
from .tiles import _CODE as CODE
from .tiles import _bytes, operations, slices

#: Numbers of the kinds of rows that leave a task.
MISMATCH, INSERTION, DELETION = 0, 1, 2


def _upper(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 97) & (raw <= 122), raw - 32, raw)


def _ascii(column: pa.Array) -> pa.Array:
    """Texts with a byte for each character."""
    if pc.all(pc.string_is_ascii(column), min_count=0).as_py():
        return column
    return pa.array([None if x is None else x.encode("ascii", "replace").decode() for x in column.to_pylist()], pa.string())


def _counts_of_batch(batch) -> tuple[np.ndarray, np.ndarray]:
    """(kind, cycle, value) of the mismatches and gaps of a batch, each once, and how many; the value of a mismatch is its quality, -1 for an N,
    that of a gap its read."""
    pos, flag, t0 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "flag", "t0"))
    (letters, at), (values, vat), (ref, rat) = (_bytes(_ascii(batch.column(k))) for k in ("seq", "qual", "parts"))
    back, n = flag & 16 != 0, np.diff(at)
    none = np.diff(vat) == 0
    none |= (np.diff(vat) == 1) & (values[np.minimum(vat[:-1], len(values) - 1)] == ord("*"))
    read, op, size, rbeg, qbeg = operations(batch.column("cigar"), len(pos))
    rbeg = rbeg + (pos - t0)[read]

    def packed(kind, cycle, value):
        return kind << 56 | cycle + 1 << 20 | value + 1

    found = []
    for kind, code in ((INSERTION, "I"), (DELETION, "D")):
        k = np.flatnonzero(op == CODE[code])
        own, y = read[k], qbeg[k]
        turned = n[own] - y - (size[k] if kind == INSERTION else 0)
        found.append(packed(kind, np.where(back[own], turned, y) - (kind == DELETION), np.where(flag[own] & 128, 2, 1)))
    k = np.flatnonzero(np.isin(op, [CODE[x] for x in "M=X"]) & (size > 0))
    k = np.repeat(k, size[k])
    step = np.arange(len(k)) - np.searchsorted(k, k)
    r, x, y = read[k], rbeg[k] + step, qbeg[k] + step
    inside = (x >= 0) & (x < np.diff(rat)[r])
    r, x, y = r[inside], x[inside], y[inside]
    if (y >= n[r]).any():
        raise ValueError("a read is shorter than its CIGAR")
    a, b = _upper(letters[at[r] + y]), _upper(ref[rat[r] + x])
    off = (a == ord("N")) | (a != b) & (b != ord("N"))
    r, y, unknown = r[off], y[off], a[off] == ord("N")
    if (~none[r] & (y >= np.diff(vat)[r])).any():
        raise ValueError("a read has fewer qualities than letters")
    value = np.where(none[r], 255, values[np.minimum(vat[r] + y, len(values) - 1)].astype(np.int64) - 33)
    found.append(packed(MISMATCH, np.where(back[r], n[r] - 1 - y, y), np.where(unknown, -1, value)))
    keys, count = np.unique(np.concatenate(found), return_counts=True)
    return np.stack([keys >> 56, (keys >> 20 & (1 << 36) - 1) - 1, (keys & (1 << 20) - 1) - 1], 1), count


def by_cycle(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """(kind, cycle, value, n) of primary mapped reads with letters, counted within each batch before they are shuffled."""
    r = primary(reads).where(none_of("flag", 4) & (F.size("cigar") > 0) & (F.length("seq") > 0) & (F.col("seq") != "*"))

    def run(batches):
        for b in batches:
            for part in slices(b):
                rows, n = _counts_of_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k], pa.int32()) for k in range(3)] + [pa.array(n, pa.int64())], ["kind", "cycle", "value", "n"])

    each = with_reference(r, reference, ("flag", "cigar", "seq", "qual")).mapInArrow(run, "kind int, cycle int, value int, n long")
    return each.groupBy("kind", "cycle", "value").agg(F.sum("n").alias("n"))


def mismatches_by_cycle(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """(cycle, qual, n): bases that differ from the reference (name, seq) by cycle and quality. Cycles count in the order of sequencing; an N of
    the read has quality -1, one of the reference differs from nothing, missing qualities are 255."""
    return by_cycle(reads, reference).where(F.col("kind") == MISMATCH).select("cycle", F.col("value").alias("qual"), "n")


def gaps_by_cycle(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """(cycle, read, insertions, deletions): gaps by the cycle at which an insertion begins, or after which bases are missing."""
    g = by_cycle(reads, reference).where(F.col("kind") != MISMATCH)
    some = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return g.groupBy("cycle", F.col("value").alias("read")).agg(some(INSERTION).alias("insertions"), some(DELETION).alias("deletions"))


def gc_depth(reads: DataFrame, window: int = 20_000, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(gc, windows, p<share>...): mean depth of windows of reads' starts by their percentage of G and C, as percentiles.

    Two aggregates: windows, then at most 101 percentages."""
    r = primary(reads).where(none_of("flag", 4) & (F.length("seq") > 0))
    gc = F.length("seq") - F.length(F.translate(F.upper("seq"), "GC", ""))
    w = r.groupBy("rname", F.floor(F.col("pos") / window).alias("_w")).agg(F.sum(gc).alias("gc"), F.sum(F.length("seq")).alias("n"))
    w = w.select(F.floor(100 * F.col("gc") / F.col("n")).cast("int").alias("gc"), (F.col("n") / window).alias("depth"))
    p = [F.round(F.percentile("depth", F.lit(s)), 6).alias(f"p{round(100 * s)}") for s in shares]
    return w.groupBy("gc").agg(F.count(F.lit(1)).alias("windows"), *p)
