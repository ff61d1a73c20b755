"""Fetching of many regions: counted regions go to the reads, and the pairs are the same past the bound."""

from strandframe.operators import intervals


def test_reads_are_not_shuffled(spark, monkeypatch):
    reads = spark.range(300).selectExpr("id AS ord", "CAST(id % 2 AS int) AS tid", "CAST(id * 7 % 500 - 90 AS int) AS pos", "CAST(id * 7 % 500 - 90 + id % 90 AS int) AS e")
    regions = spark.range(40).selectExpr("id AS rid", "CAST(id % 2 AS int) AS tid", "CAST(id * 11 AS int) AS b", "CAST(id * 11 + 100 * (id % 3) AS int) AS e")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = intervals.fetch_regions(reads, regions).select("ord", "rid")
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", 10)
        far = intervals.fetch_regions(reads, regions).select("ord", "rid")
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (near, far)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plans[0] and "Exchange hashpartitioning" in plans[1]
    got = sorted(map(tuple, near.collect()))
    r, g = reads.collect(), regions.collect()
    assert got == sorted(map(tuple, far.collect())) == sorted((x.ord, y.rid) for x in r for y in g if x.tid == y.tid and x.pos < y.e and y.b < x.e and x.e > x.pos and y.e > y.b)
