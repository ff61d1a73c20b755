"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only.

Every text becomes a digest row, written once with the number of its *run*: the task that made it. A run keeps one row
per digest, with the smallest doc_id and a count. The runs stand at ``places`` (a power of ``FAN_IN``) and merge in
binomial rounds: in round k the ``FAN_IN`` places whose numbers differ in digit k only exchange their runs. Each takes
the digests that have its digit at place k of their hexadecimal form, sorts what it was sent, and merges: of equal
digests the row with the smallest doc_id stays and takes over the counts. After the last round every digest stands at
one place, and no place ever holds more than its share of the digests, so no root task sees them all.

Rows merge only where SHA-256, length and a second, independent 64-bit hash agree (verified at every level; texts are not
compared again). The answer goes back by the same rounds: a run asks the place it sent a digest to, so a digest that
holds a third of all rows is at most one row a run at the leaves and ``FAN_IN`` rows at any place above.

Nulls: null text equals empty text; rows of null doc_id are kept only if their text has no other row
(a null id counts as larger than every id). Repeated rows with one doc_id form one group and all carry
``kept = true`` when that id stays. Empty table: empty result. Only ``doc_id`` and ``text`` are read,
so extra columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, Scratch, shuffle_parts

#: Places that exchange runs in a round: one hexadecimal digit of the digest.
FAN_IN = 16
#: What must agree of two texts.
SAME = ("text_sha256", "_len", "_h2")


def rounds_for(parts: int) -> int:
    """Rounds after which there are as many places as shuffle partitions, at least."""
    rounds = 1
    while FAN_IN**rounds < parts:
        rounds += 1
    return rounds


def digest_rows(docs: DataFrame, places: int) -> DataFrame:
    """(doc_id, text_sha256, _len, _h2, _run) of every row."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{WS}+", " ")
    return docs.select(F.col("doc_id").alias("doc_id"), norm.alias("_t")).select(
        "doc_id",
        F.sha2("_t", 256).alias("text_sha256"),
        F.length("_t").cast("long").alias("_len"),
        F.xxhash64("_t").alias("_h2"),
        F.pmod(F.spark_partition_id(), F.lit(places)).cast("int").alias("_run"),
    )


def next_place(k: int) -> Column:
    """Where round ``k`` sends a row: digit k of its place becomes digit k of its digest."""
    step = FAN_IN**k
    wanted = F.conv(F.substring("text_sha256", k + 1, 1), 16, 10).cast("int")
    own = F.pmod(F.floor(F.col("_run") / step), F.lit(FAN_IN)).cast("int")
    return F.col("_run") + (wanted - own) * F.lit(step)


def merge_round(runs: DataFrame, k: int, places: int) -> DataFrame:
    """The merged runs (_run, digest, _id, _n) after round ``k``: sent to their places, sorted, first of each digest kept."""
    sent = runs.select(next_place(k).alias("_run"), *SAME, "_id", "_n").repartition(places, "_run")
    sent = sent.sortWithinPartitions("_run", *SAME, F.col("_id").asc_nulls_last())
    run = Window.partitionBy("_run", *SAME).orderBy(F.col("_id").asc_nulls_last())
    everything = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = sent.withColumn("_total", F.sum("_n").over(everything)).withColumn("_first", F.row_number().over(run))
    return merged.where("_first = 1").select("_run", *SAME, "_id", F.col("_total").alias("_n"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    rounds = rounds_for(shuffle_parts(docs.sparkSession))
    places = FAN_IN**rounds
    # digests are written once: every level of the tree reads them, not the texts
    rows = Scratch(docs.sparkSession, "exact").store(digest_rows(docs, places), "digests")
    levels = [rows.groupBy("_run", *SAME).agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))]
    for k in range(rounds):
        levels.append(merge_round(levels[-1], k, places))
    # back: every run asks the place that it sent a digest to
    answer = levels[-1].select("_run", *SAME, F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"))
    for k in reversed(range(rounds)):
        asked = levels[k].select(F.col("_run").alias("_from"), next_place(k).alias("_run"), *SAME)
        answer = asked.join(answer, ["_run", *SAME]).select(F.col("_from").alias("_run"), *SAME, "keep_id", "group_size")
    return rows.join(answer, ["_run", *SAME]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM n JOIN g USING (h)
"""
