"""Line dedup across documents by range-partitioned line hashes.

Keys (stripped, ASCII-lowered lines) of at least ``MIN_KEY`` code points are hashed to 128 bits. The
rows (hash, document, position) are range-partitioned by all of these columns and sorted within each
partition, so a line that fills a third of all rows spans many partitions. A streaming pass over every
partition passes the first document of each hash and marks every later one. The first hash of a
partition may have begun in an earlier partition: what is left open there is one document for each
partition, settled by a join over one row per partition. Dropped positions go back per document as a
compressed keep bitmap (never text), which the texts are then cut with.

Nulls and edges: a null or empty text is one empty line. Rows with a null doc_id come after every id
and count as one document. Rows that repeat a doc_id are the same document: a line they share is not a
duplicate by itself, and equal rows are cut alike. Empty table: empty result. Only ``doc_id`` and
``text`` are read by the digest; ``dedup_lines`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import Scratch, shuffle_parts

STRIP = " \t\n\x0b\x0c\r"
MIN_KEY = 10
_LAST = (1 << 63) - 1


def line_key(line: str) -> str:
    """Fixed key: strip [\\x20\\x09-\\x0D], lower A-Z only."""
    return line.strip(STRIP).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _hash_lines(batches):
    """(d, t, pos, h1, h2) of every line long enough; d: doc_id (null last), t: hash of the text."""
    for batch in batches:
        ds, ts, ps, hs = [], [], [], []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            d = _LAST if d is None else d
            t = None
            for pos, line in enumerate(text.split("\n")):
                key = line.strip(STRIP)
                if len(key) >= MIN_KEY:
                    if t is None:
                        t = xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
                    ds.append(d)
                    ts.append(t)
                    ps.append(pos)
                    hs.append(xxhash.xxh3_128_digest(key.encode().lower()))
        h = np.frombuffer(b"".join(hs), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ds, pa.int64()), pa.array(ts, pa.int64()), pa.array(ps, pa.int32())],
            ["h1", "h2", "d", "t", "pos"],
        )


def _first_of_runs(batches):
    """Stream sorted rows; emit kind 0: a position to drop, kind 1: the partition's first document of
    its first hash (open), kind 2: the same with each partition's last run's first document (a head)."""
    run, first, opening, out_schema = None, None, True, ["kind", "h1", "h2", "d", "t", "pos"]
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, d, t, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.empty(len(d), bool)
        new[0] = run is None or (h1[0], h2[0]) != run
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        firsts = d[starts]
        lead = np.where(which >= 0, firsts[np.maximum(which, 0)] if len(firsts) else 0, first if first is not None else 0)
        kind = np.full(len(d), -1, np.int8)
        kind[d != lead] = 0
        heads = starts
        if opening:
            # rows of the partition's first hash that belong to its first document stay open
            edge = starts[1] if len(starts) > 1 and new[0] and run is None else (starts[0] if len(starts) and run is not None else len(d))
            if run is None:
                heads = starts[1:]
            kind[:edge][d[:edge] == lead[:edge]] = 1
            opening = edge == len(d)
        keep = np.flatnonzero(kind >= 0)
        run, first = (h1[-1], h2[-1]), lead[-1]
        yield pa.RecordBatch.from_arrays([pa.array(kind[keep])] + [pa.array(x[keep]) for x in (h1, h2, d, t, pos)], out_schema)
    if run is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([2], pa.int8()), pa.array([run[0]], pa.int64()), pa.array([run[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32())],
            out_schema,
        )


def keep_bitmap(n_lines: int, dropped) -> bytes:
    """Compressed bitmap, one bit a line, 1 = keep; the last byte is filled with ones."""
    bits = np.ones(-(-n_lines // 8) * 8, np.uint8)
    bits[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _bitmaps(batches):
    for b in batches:
        drops = b.column(2).to_pylist()
        maps = [keep_bitmap(max(x) + 1, x) for x in drops]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["d", "t", "bitmap"])


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """(d, t, bitmap) of the documents that lose a line: id (null as 2^63-1), text hash, keep bitmap up to the last dropped line."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = docs.select("doc_id", "text").mapInArrow(_hash_lines, "h1 long, h2 long, d long, t long, pos int")
    lines = scratch.store(lines, "hashes")
    keys = ["h1", "h2", "d", "t", "pos"]
    dealt = lines.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    marks = scratch.store(dealt.mapInArrow(_first_of_runs, "kind byte, h1 long, h2 long, d long, t long, pos int"), "marks")
    opened = marks.where("kind = 1")
    # one row a partition: the last run's first document, and its opening document
    heads = marks.where("kind = 2").select("h1", "h2", "d").unionByName(opened.select("h1", "h2", "d").distinct())
    least = heads.groupBy("h1", "h2").agg(F.min("d").alias("least"))
    late = opened.join(least, ["h1", "h2"]).where("d > least")
    drops = marks.where("kind = 0").select("d", "t", "pos").unionByName(late.select("d", "t", "pos"))
    per_doc = drops.distinct().groupBy("d", "t").agg(F.collect_list("pos").alias("drops"))
    return per_doc.mapInArrow(_bitmaps, "d long, t long, bitmap binary")


def _with_bitmaps(docs: DataFrame) -> DataFrame:
    """docs plus _bitmap (null: nothing to drop)."""
    maps = line_bitmaps(docs).toDF("_ld_md", "_ld_mt", "_ld_bitmap")
    keyed = docs.withColumn("_ld_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))

    def text_hash(batches):
        for b in batches:
            h = [xxhash.xxh3_64_intdigest((x or "").encode()) - (1 << 63) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(h, pa.int64())], [*b.schema.names[:-1], "_ld_t"])

    copy = keyed.withColumn("_ld_t", F.col("text"))
    schema = StructType([*[f for f in copy.schema.fields[:-1]]]).add("_ld_t", LongType())
    hashed = copy.mapInArrow(text_hash, schema)
    return hashed.join(maps, (F.col("_ld_d") == F.col("_ld_md")) & (F.col("_ld_t") == F.col("_ld_mt")), "left").drop("_ld_md", "_ld_mt", "_ld_d", "_ld_t")


def cut(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """Kept text, lines before, lines dropped."""
    text = text or ""
    if bitmap is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    raw = np.frombuffer(zlib.decompress(bitmap), np.uint8)
    bits = np.unpackbits(raw)[: len(lines)]
    keep = np.ones(len(lines), bool)
    keep[: len(bits)] = bits.astype(bool)
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), int((~keep).sum())


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped from ``text``; n_chars, if there, is set to the new length."""
    fields = docs.schema.fields
    names = [f.name for f in fields]
    at = names.index("text")
    counts = names.index("n_chars") if "n_chars" in names else -1

    def apply(batches):
        for b in batches:
            kept = [cut(x, m)[0] for x, m in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(kept, pa.string())
            if counts >= 0:
                columns[counts] = pa.array([len(x) for x in kept], pa.int64()).cast(columns[counts].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_bitmaps(docs).mapInArrow(apply, docs.schema)


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``."""

    def digest(batches):
        for b in batches:
            got = [cut(x, m) for x, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g[1] for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[0].encode()).hexdigest() for g in got], pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = _with_bitmaps(docs.select("doc_id", "text"))
    return rows.select("doc_id", "text", "_ld_bitmap").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, m.least IS NOT NULL AND k.doc_id <> m.least AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
