"""Exact pattern search: all overlapping occurrences of patterns in sequences.

Results are (seq, offset), offset 0-based in the ungapped sequence. N is a letter like the others, not a
wildcard; an empty pattern is an error. Sequences without the pattern are dropped inside the JVM before
any row reaches a kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import search as S

ALGORITHMS = {"s": S.find, "bmh": S.find_horspool, "dfa": S.find_dfa, "lm": S.find_signature}


def fold(pattern: str) -> str:
    """Case folded, and everything but ACGT as N."""
    if not pattern:
        raise ValueError("empty pattern")
    return "".join(x if x in "ACGT" else "N" for x in pattern.translate(str.maketrans("acgt", "ACGT")))


#: Hits that leave a task together.
HITS = 1 << 16


def batched(pieces, names: list[str]):
    """Record batches of ``HITS`` rows or a little more from pieces (an array for each of ``names``): a task holds these, not all hits of what it reads."""
    held, n = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= HITS:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def pattern_search(sequences: DataFrame, pattern: str, algorithm: str = "s") -> DataFrame:
    """(seq, offset) of one pattern, by one of s, bmh, dfa, lm."""
    p, find = fold(pattern), ALGORITHMS[algorithm]

    def run(batches):
        each = ((k.as_py(), np.array(find(s.as_py(), p), np.int32)) for b in batches for k, s in zip(b.column(0), b.column(1), strict=True))
        yield from batched(((np.full(len(got), k, np.int64), got) for k, got in each), ["seq", "offset"])

    rows = sequences.select(F.col("seq").cast("long").alias("seq"), "seqs").where(F.contains("seqs", F.lit(p)))
    return rows.mapInArrow(run, "seq long, offset int")


def pattern_search_native(sequences: DataFrame, pattern: str, chunk: int = 256) -> DataFrame:
    """The same in built-in expressions: chunks that overlap by m - 1, then every offset inside a chunk."""
    p = fold(pattern)
    m = len(p)
    rows = sequences.where(F.contains("seqs", F.lit(p))).withColumn("_n", F.length("seqs"))
    chunks = rows.select("seq", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk).cast("int")), lambda k: F.struct((k * chunk).alias("o"), F.substring("seqs", k * chunk + 1, F.lit(chunk + m - 1)).alias("c")))).alias("x"))
    hit = chunks.where(F.contains("x.c", F.lit(p))).select("seq", "x.o", "x.c")
    hit = hit.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("c") - m)))
    return hit.where(F.substring("c", F.col("i") + 1, F.lit(m)) == p).select("seq", (F.col("o") + F.col("i")).alias("offset"))


def pattern_search_multi(sequences: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, seq, offset) of a list of patterns in one pass over the sequences."""
    ps = sorted({fold(p) for p in patterns})

    def run(batches):
        rows = ((k.as_py(), s.as_py()) for b in batches for k, s in zip(b.column(0), b.column(1), strict=True))
        each = ((i, k, np.array(S.find(s, p), np.int32)) for k, s in rows for i, p in enumerate(ps))
        for b in batched(((np.full(len(got), i, np.int32), np.full(len(got), k, np.int64), got) for i, k, got in each), ["pattern", "seq", "offset"]):
            yield b.set_column(0, "pattern", pa.array(ps, pa.string()).take(b.column(0)))

    any_hit = None
    for p in ps:
        cond = F.contains("seqs", F.lit(p))
        any_hit = cond if any_hit is None else any_hit | cond
    return sequences.select(F.col("seq").cast("long").alias("seq"), "seqs").where(any_hit).mapInArrow(run, "pattern string, seq long, offset int")
