"""Mix sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every row has a 60-bit hash of its id and text. A source that must take ``q`` whole passes plus a rest
takes each row ``q`` times, and once more where its hash lies below the source's threshold. The
threshold is found without sorting documents: tokens are summed by (source, 12-bit bucket), the bucket in
which the rest is reached is located on at most 4096 sums a source, and only that bucket is refined by
the next 12 bits, five times at most. Thresholds of smaller budgets lie below those of larger ones, so
mixes of growing budgets are nested.

The hash at which the rest is reached belongs to one document or to the repeats of one. Of those, as many rows are taken
once more as leave the source nearest to its target: they are numbered by (row content, partition, row), so a document
repeated in a third of all rows is dealt over all partitions.

Nulls: null text has size 0; a null source is a source of its own, last in code-point order; a null
doc_id hashes as the empty string. Repeats of a row count each; which of them are taken cannot be told apart. Empty
table: empty result. Only doc_id, text and source are read; ``with_copies`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SALTS, WS, Scratch, salt_of, shuffle_parts

WEIGHTS = (3, 1, 2)
#: Budget as a share of all sizes, as a fraction; and the most often a source is taken.
BUDGET = (3, 2)
MOST = 2
BITS, LEVELS = 12, 5
SPAN = 1 << (BITS * LEVELS)


def size_of(text):
    """Words of a text: runs of anything but white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")).cast("long")


def hash_of(doc_id, text):
    """60 bits of id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def prefix_sums(rows: DataFrame, order: list, sums: dict, scratch: Scratch, tag: str, parts: int) -> DataFrame:
    """``rows`` with the sums of the rows before each one in ``order``. Over ``parts`` range partitions, each with its own
    running sums, to which the sums of the partitions before are added."""
    before = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda w: {k: F.coalesce(F.sum(v).over(before(w)), F.lit(0)) for k, v in sums.items()}
    if parts == 1:
        return rows.withColumns(running(Window.partitionBy(F.lit(0))))
    placed = scratch.store(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), tag)
    own = placed.groupBy("_p").agg(*[F.sum(v).alias(f"_own_{k}") for k, v in sums.items()])
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offset = own.select("_p", *[F.coalesce(F.sum(f"_own_{k}").over(w), F.lit(0)).alias(f"_off_{k}") for k in sums])
    out = placed.withColumns(running(Window.partitionBy("_p"))).join(F.broadcast(offset), "_p")
    return out.withColumns({k: F.col(k) + F.col(f"_off_{k}") for k in sums}).drop("_p", *[f"_off_{k}" for k in sums])


def source_targets(sizes: DataFrame, scratch: Scratch, parts: int = 1) -> DataFrame:
    """(source, source_size, w, target) of one row per source (``source``, ``source_size``).

    The excess over ``MOST`` times a source's size is reshared by weight until none is above. The fixed
    point stops the sources in order of cap/weight, so running sums over that order give it at once.
    Shares are integers until the last division.
    """
    by_name = F.col("source").asc_nulls_last()
    t = prefix_sums(sizes, [by_name], {"_k": F.lit(1)}, scratch, "by-name", parts)
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.pmod("_k", F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    t = t.withColumn("w", w).withColumn("_cap", F.col("source_size") * MOST).drop("_k")
    t = scratch.store(t.withColumn("_at", F.col("_cap") / F.col("w")), "weighed")
    everything = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    t = prefix_sums(t, [F.col("_at"), by_name], {"_capped": F.col("_cap"), "_gone": F.col("w")}, scratch, "by-cap", parts)
    # stopped if its share of what is left, were all earlier ones stopped, is at least its cap
    num, den = BUDGET
    budget = F.lit(int(everything["size"]) * num)
    t = t.withColumn("_stop", (budget - F.col("_capped") * den) * F.col("w") >= F.col("_cap") * den * (F.lit(int(everything["w"])) - F.col("_gone")))
    capped, free = F.sum(F.when(F.col("_stop"), F.col("_cap"))), F.sum(F.when(~F.col("_stop"), F.col("w")))
    ends = t.agg(F.coalesce(capped, F.lit(0)).alias("cap"), F.coalesce(free, F.lit(0)).alias("w")).first()
    share = ((budget - F.lit(int(ends["cap"]) * den)) * F.col("w")).cast("double") / F.lit(float(int(ends["w"]) * den))
    return t.select("source", "source_size", "w", F.when(F.col("_stop"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def _attach(rows: DataFrame, per_source: DataFrame, n_sources: int, source: str = "source", spread: str = "_hash") -> DataFrame:
    """Join per-source values: broadcast where the counted rows are few, else dealt over salts."""
    per_source = per_source.withColumnRenamed("source", "_s")
    if n_sources <= BROADCAST_ROWS:
        return rows.join(F.broadcast(per_source), F.col(source).eqNullSafe(F.col("_s"))).drop("_s")
    many = per_source.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", salt_of(spread))
    return dealt.join(many, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_salt2"))).drop("_s", "_salt", "_salt2")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"),
        hash_of(F.col("doc_id"), F.col("text")).alias("_hash"), F.monotonically_increasing_id().alias("_row"),
    )


def plan_mix(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, _q, _low, _extra, _repeats): take every row ``_q`` times, those of hash below ``_low``
    once more, and ``_extra`` of the ``_repeats`` rows of hash ``_low``."""
    per = scratch.store(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n = per.count()
    per = scratch.store(source_targets(per, scratch, 1 if n <= BROADCAST_ROWS else shuffle_parts(rows.sparkSession)), "targets")
    z = F.col("source_size")
    q = F.when(z > 0, F.floor(F.col("target") / z)).otherwise(0).cast("long")
    state = per.select("source", "source_size", "target", q.alias("_q"))
    # _low and the span from it: the hashes still open; _done: words below them, which are taken
    zero = F.lit(0).cast("long")
    state = state.withColumns({"_rest": F.col("target") - F.col("_q") * z, "_low": zero, "_done": zero})
    open_rows, span = rows.where("size > 0"), SPAN
    for level in range(LEVELS):
        span >>= BITS
        at = _attach(open_rows, state.where("_rest > 0").select("source", "_low", "_rest", "_done"), n)
        at = at.withColumn("_b", F.floor((F.col("_hash") - F.col("_low")) / F.lit(span)).cast("long")).where((F.col("_b") >= 0) & (F.col("_b") < (1 << BITS)))
        # the bucket's words are summed per (source, bucket) with map-side combine; then at most 4096 rows a source
        hist = at.groupBy("source", "_b").agg(F.sum("size").alias("_w"), F.count(F.lit(1)).alias("_c"), F.first("_rest").alias("_rest"), F.first("_done").alias("_done"))
        run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_upto", F.col("_done") + F.sum("_w").over(run))
        hit = hist.where(F.col("_upto") >= F.col("_rest")).groupBy("source").agg(F.min_by(F.struct("_b", "_upto", "_w", "_c"), "_b").alias("_hit"))
        moved = state.join(hit.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        state = moved.select(
            "source", "source_size", "target", "_q", "_rest",
            F.when(F.col("_hit").isNull(), F.col("_low")).otherwise(F.col("_low") + F.col("_hit._b") * span).alias("_low"),
            F.when(F.col("_hit").isNull(), F.col("_done")).otherwise(F.col("_hit._upto") - F.col("_hit._w")).alias("_done"),
            F.col("_hit._w").alias("_last"), F.coalesce("_hit._c", F.lit(0)).alias("_repeats"),
        )
        state = scratch.store(state, f"level{level}")
        if level:
            scratch.drop(f"level{level - 1}")
    # of the rows at the threshold, as many as come nearest to what is still to take
    each = F.col("_last") / F.col("_repeats")
    missing = F.col("_rest") - F.col("_done")
    whole = F.floor(missing / each)
    extra = F.when((F.col("_rest") <= 0) | (F.col("_repeats") == 0), 0).otherwise(whole + F.when((missing - whole * each) * 2 > each, 1).otherwise(0))
    low = F.when((F.col("_rest") <= 0) | (F.col("_repeats") == 0), F.lit(-1)).otherwise(F.col("_low"))
    return state.select("source", "source_size", "target", "_q", low.cast("long").alias("_low"), extra.cast("long").alias("_extra"), "_repeats")


def _copies(rows: DataFrame, plan: DataFrame, scratch: Scratch, row: str | None, content) -> DataFrame:
    """``rows`` (with _source, _hash) joined with the plan and ``copies``. ``row``: a column that numbers the rows, if they are
    stored; ``content``: a hash by which rows of one threshold are told apart."""
    there = plan.agg(F.count(F.lit(1)).alias("n"), F.max("_repeats").alias("most")).first()
    joined = _attach(rows, plan, there["n"], "_source")
    taken = F.col("_q") + F.when((F.col("_hash") < F.col("_low")) | ((F.col("_hash") == F.col("_low")) & (F.col("_extra") >= F.col("_repeats"))), 1).otherwise(0)
    if (there["most"] or 0) <= 1:
        return joined.withColumn("copies", taken.cast("long"))
    some = (F.col("_hash") == F.col("_low")) & (F.col("_extra") < F.col("_repeats")) & (F.col("_extra") > 0)
    rest, edge = joined.where(~some).withColumn("copies", taken.cast("long")), joined.where(some)
    if row is None:
        row, edge = "_row", scratch.store(edge.withColumn("_row", F.monotonically_increasing_id()), "edge")
    edge = edge.withColumns({"_c": content, "_p": F.shiftright(F.col(row), 33)})
    spot = [F.col("_source"), F.col("_c"), F.col("_p")]
    sums = edge.groupBy(*spot).agg(F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy("_source").orderBy("_c", "_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s"), F.col("_c").alias("_c2"), F.col("_p").alias("_p2"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    edge = edge.withColumn("_nth", F.row_number().over(Window.partitionBy(*spot).orderBy(row)))
    edge = edge.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_c2")) & (F.col("_p") == F.col("_p2")))
    edge = edge.withColumn("copies", (F.col("_q") + F.when(F.col("_before") + F.col("_nth") <= F.col("_extra"), 1).otherwise(0)).cast("long"))
    return rest.unionByName(edge.select(*rest.columns))


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.store(_sized(docs), "sized")
    out = _copies(rows.withColumnRenamed("source", "_source"), plan_mix(rows, scratch), scratch, "_row", F.lit(0))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def with_copies(docs: DataFrame, copies: str = "copies", size: str = "size") -> DataFrame:
    """``docs`` with two more columns: how often the mix takes the row, and its words. Texts are neither joined nor shuffled; only
    rows repeated at a threshold are written once more, to be numbered."""
    scratch = Scratch(docs.sparkSession, "mix")
    plan = plan_mix(scratch.store(_sized(docs), "sized"), scratch)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))
    rows = rows.select("_doc", F.col("_doc.source").alias("_source"), size_of(F.col("_doc.text")).alias("_size"), hash_of(F.col("_doc.doc_id"), F.col("_doc.text")).alias("_hash"))
    out = _copies(rows, plan, scratch, None, F.xxhash64("_doc"))
    return out.select("_doc.*", F.col("copies").alias(copies), F.col("_size").alias(size))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size) AS z FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS int) + 1] AS w, sum(z) OVER () AS tot FROM s0),
s2 AS (SELECT *, coalesce(sum(2 * z) OVER o, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS wl FROM s1
       WINDOW o AS (ORDER BY 2 * z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (3 * tot - 2 * capped) * w >= 4 * z * wl AS stop FROM s2),
s4 AS (SELECT *, sum(CASE WHEN stop THEN 2 * z ELSE 0 END) OVER () AS cs, sum(CASE WHEN stop THEN 0 ELSE w END) OVER () AS wr FROM s3),
s5 AS (SELECT source, cast(z AS bigint) AS z, CASE WHEN stop THEN cast(2 * z AS double) ELSE cast((3 * tot - 2 * cs) * w AS double) / cast(2 * wr AS double) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN z > 0 THEN cast(floor(target / z) AS bigint) ELSE 0 END AS q, target - CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END * z AS rest FROM s5),
r AS (SELECT d.*, s6.z, s6.target, s6.q, s6.rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS own, count(*) OVER (PARTITION BY d.source, h) AS c, row_number() OVER (PARTITION BY d.source, h) AS k
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
m AS (SELECT *, rest - (upto - own) AS missing, own / c AS each FROM r),
t AS (SELECT *, q + CASE WHEN rest <= 0 OR missing <= 0 THEN 0 WHEN upto < rest THEN 1
                         WHEN k <= floor(missing / each) + CASE WHEN (missing - floor(missing / each) * each) * 2 > each THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS times FROM m)
SELECT doc_id, cast(size AS bigint) AS size, z AS source_size, target, cast(size * times AS bigint) AS taken, cast(times AS bigint) AS copies FROM t
"""
