"""Views of the driver's tables in the record model, in DataFrame form and as the same DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import span  # noqa: F401

LETTERS = "".join(chr(65 + i) for i in range(26)) + "".join(chr(97 + i) for i in range(26))
AS_BASES = ("ACGT" * 7)[:26] * 2
CONTIGS = 6
TYPE_LIST = ("ord bigint", "qid bigint", "tid int", "pos int", "e int", "mapq int", "flag int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as aligned reads. ``ord`` is a 60-bit hash of the row: an arrival order that needs no sort."""
    day = F.to_date("l_shipdate")
    pos = F.date_diff(day, F.lit("1995-01-01").cast("date"))
    text = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), day)
    bit = lambda cond, value: F.when(cond, value).otherwise(0)
    line = F.col("l_linenumber")
    flag = (
        1 + bit(F.col("l_linestatus") == "F", 2) + bit((F.col("l_returnflag") == "R") & (line == 7), 4) + bit(F.col("l_partkey") % 2 == 1, 16)
        + bit(line % 2 == 1, 64) + bit(line % 2 == 0, 128) + bit((F.col("l_returnflag") == "N") & (line == 5), 512) + bit(F.col("l_suppkey") % 7 == 0, 1024)
    )
    return table(spark, sf_dir, "lineitem").select(
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("ord"),
        F.col("l_orderkey").alias("qid"),
        (F.col("l_suppkey") % 5).cast("int").alias("tid"),
        pos.alias("pos"),
        (pos + F.col("l_quantity").cast("int")).alias("e"),
        ((F.col("l_partkey") * 7) % 61).cast("int").alias("mapq"),
        flag.cast("int").alias("flag"),
    )


READS = """reads AS (SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS int), cast(l_shipdate AS date))), 1, 15))::BIGINT AS ord,
  l_orderkey AS qid, cast(l_suppkey % 5 AS int) AS tid, cast(date_diff('day', date '1995-01-01', cast(l_shipdate AS date)) AS int) AS pos,
  cast(date_diff('day', date '1995-01-01', cast(l_shipdate AS date)) + cast(l_quantity AS int) AS int) AS e, cast((l_partkey * 7) % 61 AS int) AS mapq,
  cast(1 + CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END + CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 2 = 1 THEN 16 ELSE 0 END
   + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_returnflag = 'N' AND l_linenumber = 5 THEN 512 ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN 1024 ELSE 0 END AS int) AS flag
  FROM lineitem)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as intervals of 30."""
    b = F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), (F.col("o_custkey") % 5).cast("int").alias("tid"), b.alias("b"), (b + 30).alias("e"))


REGIONS = """regions AS (SELECT o_orderkey AS rid, cast(o_custkey % 5 AS int) AS tid, cast(date_diff('day', date '1995-01-01', cast(o_orderdate AS date)) AS int) AS b,
  cast(date_diff('day', date '1995-01-01', cast(o_orderdate AS date)) + 30 AS int) AS e FROM orders)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sequences over ACGTN; translate keeps offsets (upper() would not)."""
    s = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), LETTERS, AS_BASES), "[^ACGT]", "N")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), s.alias("seqs"))


SEQUENCES = f"""sequences AS (SELECT doc_id AS seq, regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{AS_BASES}'), '[^ACGT]', 'N', 'g') AS seqs FROM documents)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sequences by rank of id, column by column up to the longer one's end: gaps stand where an N meets a base, and after
    the end of the shorter one. Texts are made sequences where they meet."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    pair = t.join(t.select((F.col("seq") - 1).alias("seq"), F.col("text").alias("other")), "seq")
    return pair.mapInArrow(_gapped, "seq long, ref_aln string, seq_aln string")


#: Letter of each ASCII character, as ``sequences`` has it.
_FOLDED = np.full(128, ord("N"), np.uint8)
_FOLDED[list(LETTERS.encode())] = list(AS_BASES.encode())


def _letters(text: str, n: int) -> np.ndarray:
    """Letters of a text, one for each code point, then gaps up to ``n``."""
    raw = np.frombuffer(text.encode("ascii") if text.isascii() else text.encode("utf-32-le", "surrogatepass"), np.uint8 if text.isascii() else np.uint32)
    out = np.full(n, ord("-"), np.uint8)
    out[: len(raw)] = np.where(raw < 128, _FOLDED[raw & 127], ord("N"))
    return out


def _gapped(batches):
    """Both sides of pairs of texts over ACGTN- with gaps where an N meets a base; pairs with an empty one are left out."""
    for batch in batches:
        for seq, *texts in zip(*(batch.column(k) for k in range(3)), strict=True):
            x, y = (t.as_py() for t in texts)
            if not x or not y:
                continue
            n = max(len(x), len(y))
            x, y = _letters(x, n), _letters(y, n)
            base = lambda s: (s != ord("N")) & (s != ord("-"))
            sides = (np.where((s == ord("N")) & base(t), ord("-"), s).astype(np.uint8).tobytes() for s, t in ((x, y), (y, x)))
            yield pa.RecordBatch.from_arrays([pa.array([seq.as_py()], pa.int64()), *(pa.array([s.decode("ascii")]) for s in sides)], ["seq", "ref_aln", "seq_aln"])


ALIGNMENTS = (
    SEQUENCES
    + """, pairs AS (SELECT s.seq, s.seqs AS a0, o.seqs AS b0, greatest(length(s.seqs), length(o.seqs)) AS n FROM sequences s JOIN sequences o ON o.seq - 1 = s.seq),
cut AS (SELECT seq, rpad(a0, cast(n AS int), '-') AS a, rpad(b0, cast(n AS int), '-') AS b, n FROM pairs WHERE length(a0) > 0 AND length(b0) > 0),
chars AS (SELECT seq, unnest(generate_series(1, n)) AS k, unnest(string_split(a, '')) AS x, unnest(string_split(b, '')) AS y FROM cut),
colops AS (SELECT seq, k, CASE WHEN x = 'N' AND y IN ('A', 'C', 'G', 'T') THEN '-' ELSE x END AS r, CASE WHEN y = 'N' AND x IN ('A', 'C', 'G', 'T') THEN '-' ELSE y END AS s FROM chars)"""
)


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as sites of 22 samples with PL triples (64 components and two zeros); the smallest of each triple is 0. Components are
    multiplied as floats, as in the SQL: Spark would widen a float times an int to a double, and halves would round otherwise."""
    e = F.concat(F.transform("embedding", lambda x: F.least(F.lit(255), F.round(F.abs(x) * F.lit(600).cast("float")).cast("int"))), F.array(F.lit(0), F.lit(0)))
    trip = F.transform(F.sequence(F.lit(1), F.lit(22)), lambda k: F.slice(e, (k - 1) * 3 + 1, 3))
    norm = F.transform(trip, lambda t: F.transform(t, lambda v: v - F.array_min(t)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("site"), "label", norm.alias("pl"))


def contigs(spark: SparkSession) -> DataFrame:
    return spark.range(CONTIGS).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("chr"), F.col("id").cast("string")).alias("name"), (F.lit(3000) + F.col("id")).cast("int").alias("len"))


CONTIG_SQL = "contigs AS (SELECT cast(i AS int) AS tid, 'chr' || i AS name, cast(3000 + i AS int) AS len FROM range(6) t(i))"
