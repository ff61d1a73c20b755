"""Likelihoods of sites from reads dealt to tiles: the same rows, and no shuffle of bases."""

from pyspark.sql import functions as F

from strandframe.operators import calling, depth, tiles
from strandframe.plans import queries as q

SF = "/root/testdata/sf0.001"


def test_tiles_hold_each_base_once(spark):
    reads = spark.range(400).selectExpr("CAST(id % 2 AS int) AS tid", "CAST(id * 7 % 300 - 90 AS int) AS pos", "CAST(id * 7 % 300 - 90 + id % 70 AS int) AS e", "CAST(IF(id % 11 = 0, 4, id % 2 * 16) AS int) AS flag", "id AS qid", "CAST(id % 61 AS int) AS mapq")
    cols = ["tid", "p", "qid", "qpos", "is_head", "is_tail"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(depth.pileup_tiles(reads)) == rows(depth.pileup(reads))
    more = {"ref": "'A'", "base": "substring('ACGT', CAST((qid + p) % 4 + 1 AS int), 1)", "baseq": "CAST((qid * 3 + p) % 41 AS int)", "sample": "CAST(qid % 3 AS int)"}
    called = lambda df: sorted(map(repr, calling.site_likelihoods(df.selectExpr("*", *[f"{v} AS {k}" for k, v in more.items()])).collect()))
    assert called(depth.pileup_tiles(reads)) == called(depth.pileup(reads))


def test_only_reads_are_shuffled(spark):
    plan = q.QUERIES["site_likelihoods"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_tile" in plan.split("Exchange hashpartitioning")[1][:60]


def test_text_shuffles_reads_only(spark):
    plan = q.QUERIES["mpileup_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_tile" in plan.split("Exchange hashpartitioning")[1][:60]


def test_deep_tiles_are_taken_apart_in_parts(spark, monkeypatch):
    """However deep a tile is, few bases are taken apart at once; text is the same in any parts."""
    rows = [(k, "c", 0, 60, 300 + k % 40, [(6, "M"), (1 + k % 2, "ID"[k % 2]), (9, "M")], "ACGTTGCAATACGTTGCA"[: 15 + (k % 2 == 0)], "I" * (15 + (k % 2 == 0)), k % 2) for k in range(400)]
    r = spark.createDataFrame(rows, "ord long, rname string, flag int, mapq int, pos int, cigar array<struct<len int, op string>>, seq string, qual string, file int")
    ref = spark.createDataFrame([("c", "GATTACAGGT" * 50)], "name string, seq string")
    seen = lambda **k: sorted(map(tuple, tiles.mpileup(r, ref, [0, 1], ahead=2, **k).collect()))
    whole = seen()
    assert whole and seen(part=100) == whole
    monkeypatch.setattr(tiles, "BASES", 1000)
    assert tiles._shorter(r.withColumn("_end", F.col("pos") + 17), 256) == tiles.SHORT and seen(part=100) == whole
