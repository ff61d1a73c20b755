"""Walks along a contig whose steps depend on the steps before, cut into tiles that run side by side.

Two forms, for two kinds of state:

* ``neighbour_walk``: a site looks at the sites within a reach and may mark them or itself, and a marked site may count no more. What a tile
  needs from before it is the marks of the sites within reach of its start. Every tile first guesses them by walking the end of the
  tile before from nothing; then each guess is held against what the tile before really left. Tiles whose guess was wrong walk again with that,
  until all agree. The first tile of a contig has nothing before it, so agreement everywhere is the one walk from the start.
  Marks forget their past within a few reaches, so a second round is rare; it is never skipped.
* ``two_state_segments``: the best path through two states. A tile's effect is a 2 x 2 matrix of best sums, matrices are multiplied along the
  contig (one row a tile), and each tile then decodes both of its possible ends and says where each would have begun; the ends are
  chosen from the right, again one row a tile.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_RESULT = "tile int, start string, stop string, marks array<struct<id:long,mark:string>>, last int"


def neighbour_walk(sites: DataFrame, step: Callable[[dict, list[dict]], None], reach: int, key: str = "chrom", pos: str = "pos", order: tuple[str, ...] = ("id",), tile: int | None = None) -> DataFrame:
    """(key, id, mark) of ``sites`` (key, id, pos, stop, and what ``step`` reads) in order of (pos, *order).

    ``step(site, near)`` gets a site as a dict with ``mark`` = "PASS" and the sites before it that end (``stop``, their last position) no more than
    ``reach`` before it, in order; it sets marks. ``reach`` must cover whatever ``step`` looks at. A site must not be longer than a tile."""
    longest = sites.agg(F.max(F.col("stop") - F.col(pos))).first()[0] or 0
    width = tile or max(1 << 12, 8 * (reach + int(longest) + 1))
    if reach + longest >= width:
        raise ValueError("a tile must be longer than the reach and the longest site")
    names = [c for c in sites.columns if c != key]
    key_type = dict(sites.dtypes)[key]
    schema = f"{key} {key_type}, {_RESULT}"
    warm = min(width - 1, 4 * (reach + int(longest) + 1))

    def shown(rows: list[dict]) -> str:
        return json.dumps([[r["id"], r["mark"]] for r in rows])

    def walk(rows: list[dict], live: list[dict]) -> list[dict]:
        """All rows and the live ones before them; ``live`` then holds what may still count."""
        for r in rows:
            live[:] = [x for x in live if x["stop"] + reach >= r[pos]]
            step(r, live)
            live.append(r)
        return rows

    def ready(pdf: pd.DataFrame) -> list[dict]:
        return [{**r, "mark": "PASS"} for r in pdf.sort_values([pos, *order], kind="stable")[names].to_dict("records")]

    def near(rows: list[dict], at: int) -> list[dict]:
        return [x for x in rows if x["stop"] + reach >= at]

    def result(own: list[dict], before: list[dict], start: str, k: int) -> dict:
        """What a tile leaves: marks of what no later tile can change, and the rest as the next one's start. Sites carried in are kept until
        they are out of reach, so their marks are told by the last tile that sees them."""
        live = list(before)
        walk(own, live)
        stop = near([*before, *own], (k + 1) * width)
        left = {id(x) for x in stop}
        done = [x for x in [*before, *own] if id(x) not in left]
        return {"tile": k, "start": start, "stop": shown(stop), "marks": [{"id": x["id"], "mark": x["mark"]} for x in done], "last": int(own[-1][pos]) if own else -1}

    def first(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(keys[1])
        own, before, live = ready(pdf[pdf["_own"]]), ready(pdf[~pdf["_own"]]), []
        walk(before, live)
        before = near(before, k * width)
        return pd.DataFrame([{key: keys[0], **result(own, before, shown(before), k)}])

    def again(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(keys[1])
        start = pdf["_start"].iloc[0]
        marks = dict(json.loads(start))
        before = [{**r, "mark": marks[r["id"]]} for r in ready(pdf[~pdf["_own"]]) if r["id"] in marks]
        return pd.DataFrame([{key: keys[0], **result(ready(pdf[pdf["_own"]]), before, start, k)}])

    k = F.floor(F.col(pos) / width).cast("int")
    rows = sites.withColumn("_tile", k)
    ahead = rows.where((F.col("_tile") + 1) * width - F.col("stop") <= warm).withColumns({"_tile": F.col("_tile") + 1, "_own": F.lit(False)})
    rows = stored(rows.withColumn("_own", F.lit(True)).unionByName(ahead), "rows")
    state = stored(rows.groupBy(key, "_tile").applyInPandas(first, schema), "round0")
    by = Window.partitionBy(key).orderBy("tile")  # one row a tile
    n = 0
    while True:
        n += 1
        joined = F.lag("tile").over(by) == F.col("tile") - 1
        told = state.withColumn("_start", F.when(joined, F.lag("stop").over(by)).otherwise("[]"))
        wrong = stored(told.where(F.col("_start") != F.col("start")).select(key, F.col("tile").alias("_tile"), "_start"), f"wrong{n}")
        if wrong.isEmpty():
            break
        mended = rows.join(wrong, [key, "_tile"]).groupBy(key, "_tile").applyInPandas(again, schema)
        kept = state.join(wrong.select(key, F.col("_tile").alias("tile")), [key, "tile"], "left_anti")
        state = stored(kept.unionByName(mended), f"round{n}")
    # a tile's last sites are told by the next tile, or by itself where none follows
    follows = F.coalesce(F.lead("tile").over(by) == F.col("tile") + 1, F.lit(False))
    ends = state.withColumn("_open", F.when(~follows, F.from_json("stop", "array<array<string>>")))
    told = F.concat("marks", F.coalesce(F.transform("_open", lambda x: F.struct(x[0].cast("long").alias("id"), x[1].alias("mark"))), F.array().cast("array<struct<id:long,mark:string>>")))
    return ends.select(key, F.explode(told).alias("x")).select(key, "x.id", "x.mark")


# --- variant sites


def site_marks(sites: DataFrame, min_mapq: int = 10, depth: tuple[int, int] = (2, 10_000_000), min_alt: int = 2, bias: tuple[float, ...] = (1e-4, 1e-100, 0.0, 1e-4), min_gq: int = 0, max_sp: int = 1000, hwe: float = 1e-4) -> DataFrame:
    """Adds ``kind`` (1 SNP, 2 MNP, 3 gap), ``score`` and ``own``, what a site's annotations alone say of it (PASS, few_alt, low_depth, high_depth,
    low_mapq, bias, extreme, hwe), to site lines (ref, alt, qual, info); sites without alternative or with unknown reference go.

    Depth comes first, then few alternative bases override it; mapping quality, the four bias tests and the samples' maxima only count for
    sites without fault; an excess of heterozygotes (``HWE`` below its bound and F < 0) overrides all. Annotations that are missing say nothing."""
    info = lambda k: F.col("info")[k]
    number = lambda x: F.expr(f"try_cast({x} AS double)")
    s = sites.where((F.element_at("alt", 1) != ".") & (F.col("ref") != "N"))
    other = F.exists("alt", lambda a: F.when(F.length("ref") > 1, F.length(a) != F.length("ref")).otherwise(F.length(a) > 1))
    dp4 = F.transform(F.split(info("DP4"), ","), lambda x: x.cast("int"))
    alt = F.coalesce(dp4[2] + dp4[3], F.lit(-1))
    dp = F.coalesce(number("info['DP']"), dp4[0] + dp4[1] + dp4[2] + dp4[3], F.lit(-1))
    mq = F.coalesce(number("info['MQ']"), F.lit(-1))
    p = F.transform(F.split(info("PV4"), ","), lambda x: x.cast("double"))
    biased = F.coalesce((p[0] < bias[0]) | (p[1] < bias[1]) | (p[2] < bias[2]) | (p[3] < bias[3]), F.lit(False))
    extreme = F.coalesce(number("info['MXGQ']") < min_gq, F.lit(False)) | F.coalesce(number("info['MXSP']") >= max_sp, F.lit(False))
    g = F.transform(F.split(info("G3"), ","), lambda x: x.cast("double"))
    a = 2 * g[0] + g[1]
    excess = F.coalesce((number("info['HWE']") < hwe) & (a > 0) & (a < 1) & (1 - g[1] / (a * (1 - a)) < 0), F.lit(False))
    first = F.when((alt >= 0) & (alt < min_alt), "few_alt").when((dp >= 0) & (dp < depth[0]), "low_depth").when((dp >= 0) & (dp > depth[1]), "high_depth")
    own = F.when(excess, "hwe").otherwise(F.coalesce(first, F.when((mq >= 0) & (mq < min_mapq), "low_mapq").when(biased, "bias").when(extreme, "extreme").otherwise("PASS")))
    return s.withColumns({"kind": F.when(other, 3).when(F.length("ref") > 1, 2).otherwise(1), "score": F.coalesce("qual", F.lit(0.0)) * 100 + alt, "own": own})


def variant_filter(sites: DataFrame, near: int = 3, gap_reach: int = 10, tile: int | None = None, **bounds) -> DataFrame:
    """Site lines (id as long, chrom, pos, ref, alt, qual, info) with ``filter``: what ``site_marks`` says, or what neighbours do.

    Along a contig, in order of position and id: a faultless gap marks faultless SNPs and MNPs that end within ``near`` before it (near_gap), and of
    it and faultless gaps within ``gap_reach`` the lower score goes (gap_pair). A faultless SNP or MNP goes if a gap ends within ``near`` before it,
    faulty or not; but if that gap only inserted the SNP's letter just before it, the gap goes. Of overlapping SNPs and MNPs the lower score
    goes (mnp_pair). A site that went counts no more where faultless ones are asked for, so order matters: see ``neighbour_walk``."""

    def step(r: dict, before: list[dict]) -> None:
        r["mark"] = r["own"]
        if r["mark"] != "PASS":
            return
        within = lambda reach: [x for x in before if x["stop"] + reach >= r["pos"]]
        if r["kind"] == 3:
            for x in within(near):
                if x["kind"] < 3 and x["mark"] == "PASS":
                    x["mark"] = "near_gap"
            for x in within(gap_reach):
                if x["kind"] == 3 and x["mark"] == "PASS":
                    if int(x["score"]) >= r["score"]:
                        r["mark"] = "gap_pair"
                        return
                    x["mark"] = "gap_pair"
            return
        gap = next((x for x in within(near) if x["kind"] == 3), None)
        if gap is not None:
            inserted = len(gap["alts"]) - len(gap["ref"]) == 1 and gap["alts"][-1:] == r["alts"][:1] and gap["pos"] + len(gap["alts"]) - 1 == r["pos"]
            (gap if inserted else r)["mark"] = "near_gap"
        for x in within(0):
            if x["kind"] < 3:
                if int(x["score"]) >= r["score"]:
                    r["mark"] = "mnp_pair"
                    return
                x["mark"] = "mnp_pair"

    s = site_marks(sites, **bounds)
    rows = s.select("chrom", "id", F.col("pos").cast("long").alias("pos"), (F.col("pos") + F.length("ref") - 1).cast("long").alias("stop"), "kind", "score", "own", "ref", F.array_join("alt", ",").alias("alts"))
    marks = neighbour_walk(rows, step, max(near, gap_reach), tile=tile)
    return s.join(marks.withColumnRenamed("mark", "filter"), ["chrom", "id"]).drop("kind", "score", "own")


# --- two states


def _product(scores: np.ndarray, joins: np.ndarray, stay: float, switch: float) -> np.ndarray:
    """Best sums from the state before the first row to the state at the last; a row that does not join the one before takes no cost for a change."""
    out = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
    for e, j in zip(scores, joins, strict=True):
        a, b = (stay, switch) if j else (0.0, 0.0)
        out = np.stack([np.maximum(out[:, 0] + a, out[:, 1] + b) + e[0], np.maximum(out[:, 1] + a, out[:, 0] + b) + e[1]], 1)
    return out


def two_state_segments(depths: DataFrame, min_depth: int = 3, gap: int = 100, stay: float = 0.0, switch: float = -2.0, tile: int = 1 << 14) -> DataFrame:
    """(chrom, beg, end) of the runs of the high state on the best path over covered positions (chrom, pos, depth), one row a position. A position scores 1
    for the high state from ``min_depth`` on and -1 below, the low state the other way round; a change costs ``-switch``. Over more than ``gap``
    positions without cover the path starts anew. Ties stay in the same state; at the end the low state wins them."""
    rows = depths.select("chrom", F.col("pos").cast("long").alias("pos"), (F.col("depth") >= min_depth).alias("high"), F.floor(F.col("pos") / tile).cast("long").alias("_tile"))
    rows = stored(rows, "depths")
    ends = rows.groupBy("chrom", "_tile").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    by = Window.partitionBy("chrom").orderBy("_tile")  # one row a tile
    ends = ends.select("chrom", "_tile", F.coalesce(F.col("_lo") - F.lag("_hi").over(by) <= gap, F.lit(False)).alias("_joins"), F.coalesce(F.lead("_lo").over(by) - F.col("_hi") <= gap, F.lit(False)).alias("_goes_on"))
    rows = rows.join(ends, ["chrom", "_tile"])

    def parts(pdf: pd.DataFrame):
        pdf = pdf.sort_values("pos")
        pos, high = pdf["pos"].to_numpy(), pdf["high"].to_numpy() * 2.0 - 1.0
        joins = np.append(pdf["_joins"].iloc[0], np.diff(pos) <= gap)
        return pos, np.stack([-high, high], 1), joins

    def matrix(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        _, scores, joins = parts(pdf)
        m = _product(scores, joins, stay, switch)
        return pd.DataFrame([(keys[0], keys[1], *np.maximum(m, -1e300).ravel())], columns=["chrom", "_tile", "m00", "m01", "m10", "m11"])

    def forward(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_tile")
        v, out = np.zeros(2), []
        for t, *m in pdf[["_tile", "m00", "m01", "m10", "m11"]].itertuples(index=False):
            out.append((keys[0], t, *v))
            v = np.max(v[:, None] + np.array(m).reshape(2, 2), 0)
            v = v - v.max()  # only differences count
        return pd.DataFrame(out, columns=["chrom", "_tile", "v0", "v1"])

    def decode(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        """For each state at the end: the state before the tile, and the runs of the high state as (from, to) one after the other."""
        pos, scores, joins = parts(pdf)
        v = pdf[["v0", "v1"]].iloc[0].to_numpy(float)
        back = np.zeros((len(pos), 2), np.int8)
        for i, (e, j) in enumerate(zip(scores, joins, strict=True)):
            a, b = (stay, switch) if j else (0.0, 0.0)
            # over a break both states come from the better one before, the low one on ties
            other = v[::-1] + b > v + a if j else np.array([v[1] > v[0], v[1] <= v[0]])
            back[i] = np.where(other, [1, 0], [0, 1])
            v = np.where(other, v[::-1] + b, v + a) + e
        best = int(v[1] > v[0])
        out = []
        for end in (0, 1):
            path = np.empty(len(pos), np.int8)
            k = end
            for i in range(len(pos) - 1, -1, -1):
                path[i] = k
                k = back[i, k]
            # a run also ends where the cover does
            new = np.append(True, (np.diff(path) != 0) | ~joins[1:])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            went_on = bool(joins[0] and k)
            runs = [{"beg": int(pos[a]), "end": int(pos[b]) + 1, "cont": bool(a == 0 and went_on), "edge": bool(a == 0 or b == len(pos) - 1)} for a, b in zip(first, last, strict=True) if path[a]]
            out.append((keys[0], keys[1], end, int(k), best, runs))
        return pd.DataFrame(out, columns=["chrom", "_tile", "end", "before", "best", "runs"])

    def choose(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        k, out = None, []
        for t, own in sorted(pdf.groupby("_tile"), reverse=True):
            if k is None or not own["_goes_on"].iloc[0]:
                k = int(own["best"].iloc[0])
            out.append((keys[0], t, k))
            k = int(own.loc[own["end"] == k, "before"].iloc[0])
        return pd.DataFrame(out, columns=["chrom", "_tile", "end"])

    kind = dict(depths.dtypes)["chrom"]
    m = rows.groupBy("chrom", "_tile").applyInPandas(matrix, f"chrom {kind}, _tile long, m00 double, m01 double, m10 double, m11 double")
    v = m.groupBy("chrom").applyInPandas(forward, f"chrom {kind}, _tile long, v0 double, v1 double")
    both = rows.join(v, ["chrom", "_tile"]).groupBy("chrom", "_tile").applyInPandas(decode, f"chrom {kind}, _tile long, end int, before int, best int, runs array<struct<beg:long,end:long,cont:boolean,edge:boolean>>")
    both = stored(both, "decoded")
    picked = both.drop("runs").join(ends, ["chrom", "_tile"]).groupBy("chrom").applyInPandas(choose, f"chrom {kind}, _tile long, end int")
    runs = both.join(picked, ["chrom", "_tile", "end"]).select("chrom", F.explode("runs").alias("x")).select("chrom", "x.*")
    # runs that a tile's border cut are one again; at most two a tile
    so_far = Window.partitionBy("chrom").orderBy("beg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = runs.where("edge").withColumn("_run", F.sum((~F.col("cont")).cast("int")).over(so_far))
    edge = edge.groupBy("chrom", "_run").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).select("chrom", "beg", "end")
    return runs.where("not edge").select("chrom", "beg", "end").unionByName(edge)
