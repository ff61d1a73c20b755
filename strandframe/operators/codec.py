"""Codec over DataFrames: a group of alignments shares one dictionary and is coded in one task; groups run apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import compress, decompress, load
from ..functions.search import PatternSet, PhraseSearch, PhraseWalk
from .search import batched, fold

STATS = ("matches", "replaces", "insertions", "deletions", "match_runs", "replace_runs", "insert_runs", "delete_runs", "items", "bits")


def compress_groups(alignments: DataFrame, group: str = "grp", sync: int = 200) -> DataFrame:
    """(grp, data): one container per group of (grp, seq, ref_aln, seq_aln)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        data, _ = compress([(str(a), b, c) for a, b, c in zip(pdf["seq"], pdf["ref_aln"], pdf["seq_aln"], strict=True)], sync)
        return pd.DataFrame({"grp": [pdf[group].iloc[0]], "data": [data]})

    return alignments.select(group, "seq", "ref_aln", "seq_aln").groupBy(group).applyInPandas(one, "grp long, data binary")


def decompress_groups(containers: DataFrame, references: DataFrame) -> DataFrame:
    """(seq, seqs) from containers and (grp, seq, ref) rows."""

    def one(batches):
        for pdf in batches:
            for data, refs in zip(pdf["data"], pdf["refs"], strict=True):
                yield pd.DataFrame([(int(n), s) for n, s in decompress(bytes(data), [r["ref"] for r in refs])], columns=["seq", "seqs"])

    return _with_references(containers, references).select("data", "refs").mapInPandas(one, "seq long, seqs string")


#: A loaded group: its phrases (the phrase each extends, its last letter, its length) and the phrase numbers of its sequences.
INDEX = "grp long, parent array<int>, symbol array<int>, length array<int>, seqs array<long>, codes array<array<int>>"


def _with_references(containers: DataFrame, references: DataFrame) -> DataFrame:
    refs = references.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("seq", "ref"))).alias("refs"))
    return containers.join(refs, "grp")


def load_groups(containers: DataFrame, references: DataFrame) -> DataFrame:
    """``INDEX`` rows of containers, to be stored and searched any number of times. References are needed here only."""

    def one(batches):
        for pdf in batches:
            for grp, data, refs in zip(pdf["grp"], pdf["data"], pdf["refs"], strict=True):  # a group leaves the task before the next is loaded
                names, trie, codes = load(bytes(data), [r["ref"] for r in refs])
                yield pd.DataFrame([(grp, trie.parent, trie.symbol, trie.length, [int(n) for n in names], codes)], columns=["grp", "parent", "symbol", "length", "seqs", "codes"])

    return _with_references(containers, references).select("grp", "data", "refs").mapInPandas(one, INDEX)


def _groups(batches):
    """((parent, symbol, length), sequences) of each loaded group, sequences as (name, phrase numbers); one at a time becomes a list."""
    for b in batches:
        *trie, names, codes = (b.column(k) for k in ("parent", "symbol", "length", "seqs", "codes"))
        for i in range(b.num_rows):
            own = codes[i].values
            ends, flat = own.offsets.to_numpy(), own.values.to_numpy()
            cuts = zip(names[i].values.to_numpy().tolist(), ends[:-1], ends[1:], strict=True)
            yield tuple(c[i].values.to_numpy() for c in trie), ((name, flat[lo:hi].tolist()) for name, lo, hi in cuts)


def search_groups(index: DataFrame, pattern: str) -> DataFrame:
    """(seq, offset) of all occurrences of a pattern, found on the phrases of loaded groups; sequences are never decompressed."""
    p = fold(pattern)

    def run(batches):
        def hits():
            for trie, sequences in _groups(batches):
                s = PhraseSearch(p, *(x.astype(np.int64) for x in trie))
                for seq, codes in sequences:
                    got = np.array(s.find(codes), np.int32)
                    yield np.full(len(got), seq, np.int64), got

        yield from batched(hits(), ["seq", "offset"])

    return index.select("parent", "symbol", "length", "seqs", "codes").mapInArrow(run, "seq long, offset int")


def save_index(index: DataFrame, path: str) -> None:
    """Loaded groups as a table at ``path``, from which any session may search; ordered by group within files, so that groups can be chosen."""
    index.sortWithinPartitions("grp").write.mode("overwrite").option("compression", "zstd").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def search_many(index: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, seq, offset) of all occurrences of each pattern, in one pass over the phrases of loaded groups. Patterns are folded and each
    is reported once; the automaton of all of them goes with the tasks, so they are a list, not a table. No patterns: no rows."""
    ps = sorted({fold(p) for p in patterns})

    def run(batches):
        found = PatternSet(ps)

        def hits():
            for trie, sequences in _groups(batches):
                walk = PhraseWalk(found, *(x.tolist() for x in trie))
                for seq, codes in sequences:
                    which, offsets = np.array(walk.find(codes), np.int32).reshape(-1, 2).T
                    yield which, np.full(len(which), seq, np.int64), offsets

        for b in batched(hits(), ["pattern", "seq", "offset"]):
            yield b.set_column(0, "pattern", pa.array(ps, pa.string()).take(b.column(0)))

    return index.select("parent", "symbol", "length", "seqs", "codes").mapInArrow(run, "pattern string, seq long, offset int")


def codec_stats(alignments: DataFrame, group: str = "grp", sync: int = 0) -> DataFrame:
    """Counts, runs, items and bits per sequence."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        _, stats = compress([(str(a), b, c) for a, b, c in zip(pdf["seq"], pdf["ref_aln"], pdf["seq_aln"], strict=True)], sync)
        return pd.DataFrame([{"seq": s} | x for s, x in zip(pdf["seq"], stats, strict=True)])

    return alignments.select(group, "seq", "ref_aln", "seq_aln").groupBy(group).applyInPandas(one, "seq long, " + ", ".join(f"{k} long" for k in STATS))


def column_ops(alignments: DataFrame) -> DataFrame:
    """(seq, col, op, base) by column of each alignment; columns of two gaps vanish."""
    both = F.zip_with(F.split("ref_aln", ""), F.split("seq_aln", ""), lambda r, s: F.struct(r.alias("r"), s.alias("s")))
    rows = alignments.where(F.length("ref_aln") > 0).select("seq", F.posexplode(both).alias("col", "x"))
    op = F.when(F.col("x.r") == "-", "I").when(F.col("x.s") == "-", "D").when(F.col("x.r") == F.col("x.s"), "M").otherwise("X")
    return rows.where(~((F.col("x.r") == "-") & (F.col("x.s") == "-"))).select("seq", "col", op.alias("op"), F.col("x.s").alias("base"))


def _columns(ref_aln: str, seq_aln: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters of both sides of an alignment, without the columns of two gaps."""
    r, s = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (ref_aln, seq_aln))
    both = (r != _GAP) | (s != _GAP)
    return r[both], s[both]


_GAP, _OPS = ord("-"), "MXID"


def op_runs(alignments: DataFrame) -> DataFrame:
    """(seq, op, columns, runs): columns and maximal runs of each operation, an alignment at a time."""

    def run(batches):
        for b in batches:
            out = []
            for seq, x, y in zip(*(b.column(k) for k in range(3)), strict=True):
                r, s = _columns(x.as_py(), y.as_py())
                op = np.where(r == _GAP, 2, np.where(s == _GAP, 3, r != s))
                columns, runs = np.bincount(op, minlength=4), np.bincount(op[np.flatnonzero(np.diff(op, prepend=-1))], minlength=4)
                out += [(seq.as_py(), _OPS[k], int(columns[k]), int(runs[k])) for k in np.flatnonzero(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["seq", "op", "columns", "runs"])

    rows = alignments.where(F.length("ref_aln") > 0).select(F.col("seq").cast("long").alias("seq"), "ref_aln", "seq_aln")
    return rows.mapInArrow(run, "seq long, op string, columns int, runs int")


def sync_map(alignments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, pos): reference positions at which a run of changed positions, over all alignments of one ``by`` that reach there, has just ended.

    A row is 64 positions of an alignment: which of them it reaches, which it changes, and whether it changes the one before them. These are
    ors of bits, combined before the shuffle."""
    kinds = {f.name: f.dataType for f in alignments.schema if f.name in by}
    schema = ", ".join([*(f"{k} {kinds[k].simpleString()}" for k in by), "word long", "reached long", "changed long", "before long"])

    def run(batches):
        for b in batches:
            for k, (x, y) in enumerate(zip(b.column("ref_aln"), b.column("seq_aln"), strict=True)):
                r, s = _columns(x.as_py(), y.as_py())
                at = r != _GAP
                off = (r != s)[at]
                words = len(off) // 64 + 1  # the last one may hold nothing but what stands before it
                bits = lambda v: np.packbits(np.pad(v, (0, words * 64 - len(v))), bitorder="little").view("<i8")  # noqa: B023, E731
                changed = bits(off)
                before = np.concatenate([[0], (changed[:-1] < 0).astype(np.int64)])
                own = [pa.array([b.column(c)[k].as_py()] * words, b.schema.field(c).type) for c in by]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (np.arange(words), bits(np.ones(len(off), bool)), changed, before))], [*by, "word", "reached", "changed", "before"])

    w = alignments.where(F.length("ref_aln") > 0).select(*by, "ref_aln", "seq_aln").mapInArrow(run, schema)
    w = w.groupBy(*by, "word").agg(*[F.bit_or(c).alias(c) for c in ("reached", "changed", "before")])
    ends = F.expr("(shiftleft(changed, 1) | before) & ~changed & reached")
    w = w.select(*by, "word", ends.alias("_e")).where("_e <> 0")
    return w.select(*by, F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(_e, i) & 1) = 1)")).alias("_i"), "word").select(*by, (F.col("word") * 64 + F.col("_i")).cast("int").alias("pos"))
