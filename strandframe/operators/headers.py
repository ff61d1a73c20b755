"""Header lines as a DataFrame (line_no, type, tags): merge, replace, order tags, read-group clean-up, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import tag

#: Fixed: the tag that names a line of each type.
KEYS = {"SQ": "SN", "RG": "ID", "PG": "ID"}


def line_key():
    own = F.create_map(*[x for k, v in KEYS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at("tags", F.try_element_at(own, F.col("type")))


def merge_headers(*headers: DataFrame) -> DataFrame:
    """Union of header lines; of lines of one type and name the first input's stays; HD comes once."""
    out = None
    for k, h in enumerate(headers):
        part = h.select(F.lit(k).alias("_file"), "line_no", "type", "tags")
        out = part if out is None else out.unionByName(part)
    key = F.when(F.col("type") == "HD", "HD").otherwise(F.coalesce(line_key(), F.concat_ws("\t", F.map_keys("tags"), F.map_values("tags"))))
    w = Window.partitionBy("type", "_key").orderBy("_file", "line_no")
    return out.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").orderBy("_file", "line_no").select("line_no", "type", "tags")


def set_sort_order(header: DataFrame, order: str) -> DataFrame:
    """SO of the HD line."""
    new = F.map_concat(F.map_filter("tags", lambda k, _: k != "SO"), F.create_map(F.lit("SO"), F.lit(order)))
    return header.withColumn("tags", F.when(F.col("type") == "HD", new).otherwise(F.col("tags")))


def keep_read_groups(header: DataFrame, groups: list[str]) -> DataFrame:
    """Drop @RG lines that are not listed."""
    return header.where((F.col("type") != "RG") | F.try_element_at("tags", F.lit("ID")).isin(*groups))


def contig_table(header: DataFrame) -> DataFrame:
    """(tid, name, len) in header order."""
    sq = header.where("type = 'SQ'")
    return sq.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("tid"), F.col("tags")["SN"].alias("name"), F.col("tags")["LN"].cast("int").alias("len"))


def read_group_table(header: DataFrame) -> DataFrame:
    """(rg, lb, sm)."""
    rg = header.where("type = 'RG'")
    return rg.select(F.col("tags")["ID"].alias("rg"), F.try_element_at("tags", F.lit("LB")).alias("lb"), F.try_element_at("tags", F.lit("SM")).alias("sm"))


def with_sample(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds rg, lb, sm by the RG tag; untagged reads take the only group of a header that has one."""
    only = groups.agg(F.count(F.lit(1)).alias("n"), F.first("rg").alias("only")).first()
    rg = tag("tags", "RG")
    if only["n"] == 1:
        rg = F.coalesce(rg, F.lit(only["only"]))
    return reads.withColumn("rg", rg).join(F.broadcast(groups), "rg", "left")


def check_targets(a: DataFrame, b: DataFrame) -> None:
    """Raise unless two contig tables list the same names and lengths."""
    if not a.select("name", "len").exceptAll(b.select("name", "len")).isEmpty() or not b.select("name", "len").exceptAll(a.select("name", "len")).isEmpty():
        raise ValueError("the inputs do not share their target sequences")
