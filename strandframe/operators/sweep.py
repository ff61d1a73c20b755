"""Running sums along a coordinate that split one contig over many tasks.

A window over a whole contig puts a third of all rows into one task when a contig is hot. Here events are
first summed per position (map-side combine), then running sums are taken inside tiles of ``TILE``
positions, and each tile starts from the sum of the tiles before it, of which there is one row per tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 14


def _tiled(points: DataFrame, key: list[str], pos: str, tile: int) -> DataFrame:
    return points.withColumn("_tile", F.floor(F.col(pos) / tile).cast("int"))


def tiled_max(points: DataFrame, key: list[str], pos: str, value, name: str, inclusive: bool = True, tile: int = TILE) -> DataFrame:
    """Adds ``name``: the largest ``value`` over the same key at positions before this one (and at it, if ``inclusive``); one row
    per (key, pos) is expected."""
    return _extreme(points, key, pos, value, name, F.max, F.greatest, Window.unboundedPreceding, 0 if inclusive else -1, tile)


def tiled_next(points: DataFrame, key: list[str], pos: str, name: str, tile: int = TILE) -> DataFrame:
    """Adds ``name``: the next position of the same key, or null."""
    return _extreme(points, key, pos, F.col(pos), name, F.min, F.least, 1, Window.unboundedFollowing, tile)


def _extreme(points, key, pos, value, name, agg, pick, start, stop, tile) -> DataFrame:
    p = _tiled(points, key, pos, tile).withColumn("_v", value)
    inside = Window.partitionBy(*key, "_tile").orderBy(pos).rowsBetween(start, stop)
    per = p.groupBy(*key, "_tile").agg(agg("_v").alias("_t"))
    outside = (Window.unboundedPreceding, -1) if start == Window.unboundedPreceding else (1, Window.unboundedFollowing)
    per = per.select(*key, "_tile", agg("_t").over(Window.partitionBy(*key).orderBy("_tile").rowsBetween(*outside)).alias("_b"))
    return p.withColumn(name, agg("_v").over(inside)).join(per, [*key, "_tile"]).withColumn(name, pick(name, "_b")).drop("_tile", "_v", "_b")


def tiled_rank(rows: DataFrame, key: list[str], pos: str, order: list, name: str, tile: int = TILE) -> DataFrame:
    """Adds ``name``: the 1-based rank of each row within its key by ``pos``, then ``order``. A tile ranks its own rows and adds the
    number of rows in the tiles before, so a hot key is many tasks."""
    p = _tiled(rows, key, pos, tile)
    per = p.groupBy(*key, "_tile").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*key, "_tile", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy(*key, "_tile").orderBy(pos, *order))
    return p.withColumn("_k", own).join(per, [*key, "_tile"]).withColumn(name, F.col("_k") + F.col("_b")).drop("_tile", "_k", "_b")


def islands(points: DataFrame, key: list[str], pos: str, gap: int, name: str = "_island", tile: int = TILE) -> DataFrame:
    """Adds ``name``: the first position of the run of positions, none over ``gap`` apart, that a row belongs to."""
    p = tiled_max(points, key, pos, F.col(pos), "_last", inclusive=False, tile=tile)
    fresh = F.when(F.col("_last").isNull() | (F.col(pos) - F.col("_last") > gap), F.col(pos))
    return tiled_max(p, key, pos, fresh, name, tile=tile).drop("_last")


def tiled_cumsum(points: DataFrame, key: list[str], pos: str, cols: list[str], tile: int = TILE) -> DataFrame:
    """Adds cum_<col> (sum over the same key at positions <= this one); one row per (key, pos) is expected."""
    p = points.withColumn("_tile", F.floor(F.col(pos) / tile).cast("int"))
    inside = Window.partitionBy(*key, "_tile").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in cols})
    tiles = p.groupBy(*key, "_tile").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    before = Window.partitionBy(*key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(*key, "_tile", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in cols])
    out = p.join(tiles, [*key, "_tile"])
    return out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_b_{c}") for c in cols}).drop("_tile", *[f"_b_{c}" for c in cols])
