"""Biases of the places that alternative letters have within their reads: rank-sum z and distance bias.

A place is a bin of ``BINS`` along a read. Bins are counted per site with map-side combine, so deep sites reach the second step as at most
``BINS`` rows; sums over the bins of a site then give both measures. A site with fewer than ``EXACT`` letters on both sides takes its
z from the exact distribution of the rank sum, which is made once for all numbers of letters that small.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, EXACT = 100, 8
#: Mean and spread of the mean distance of 3 to 23 letters, for reads of 100.
SPREAD = (
    (9.108, 4.934), (9.999, 3.991), (10.273, 3.485), (10.579, 3.160), (10.828, 2.889), (11.014, 2.703), (11.028, 2.546), (11.244, 2.391), (11.231, 2.320), (11.323, 2.138), (11.403, 2.123),
    (11.394, 1.994), (11.451, 1.928), (11.445, 1.862), (11.516, 1.815), (11.560, 1.761), (11.544, 1.728), (11.605, 1.674), (11.592, 1.652), (11.674, 1.613), (11.641, 1.570),
)


def place_counts(pile: DataFrame, key=("tid", "pos"), ref: str = "ref") -> DataFrame:
    """(key, place, n_ref, n_alt) of a pile with qpos (from 0, without clips), len, base and ``ref``."""
    place = F.floor((F.col("qpos") + 1) / (F.col("len") + 1) * BINS).cast("int")
    is_ref = F.col("base") == F.col(ref)
    return pile.groupBy(*key, place.alias("place")).agg(F.count_if(is_ref).alias("n_ref"), F.count_if(~is_ref).alias("n_alt"))


def place_sums(counts: DataFrame, key=("tid", "pos")) -> DataFrame:
    """(key, n_ref, n_alt, u, distance): letters on both sides; the rank sum, which counts for each alternative letter the reference letters at its
    place or before; and the mean distance of alternative letters' distances to the nearer end from their mean."""
    g = counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "n_ref", "n_alt"))).alias("_b"))
    zero = F.lit(0).cast("long")
    ranks = F.aggregate("_b", F.struct(zero.alias("r"), zero.alias("u")), lambda s, x: F.struct((s["r"] + x["n_ref"]).alias("r"), (s["u"] + (s["r"] + x["n_ref"]) * x["n_alt"]).alias("u")))
    near = lambda x: F.when(x["place"] < BINS // 2, x["place"]).otherwise(BINS - x["place"])
    total = lambda f: F.aggregate("_b", F.lit(0.0), lambda s, x: s + f(x))
    g = g.withColumns({"_r": ranks, "n_alt": F.aggregate("_b", zero, lambda s, x: s + x["n_alt"])})
    g = g.withColumn("_mean", F.when(F.col("n_alt") > 0, total(lambda x: near(x) * x["n_alt"]) / F.col("n_alt")))
    away = F.when(F.col("n_alt") > 0, total(lambda x: F.abs(near(x) - F.col("_mean")) * x["n_alt"]) / F.col("n_alt"))
    return g.select(*key, F.col("_r.r").alias("n_ref"), "n_alt", F.col("_r.u").alias("u"), away.alias("distance"))


@cache
def rank_sum_distribution(n: int, m: int) -> tuple[float, ...]:
    """Chance of each rank sum from 0 to n * m when n and m letters stand in any order: the last one is of either kind."""
    out = np.zeros(n * m + 1)
    if not n or not m:
        out[0] = 1.0
        return tuple(out)
    one, other = rank_sum_distribution(n - 1, m), rank_sum_distribution(n, m - 1)
    out[m : m + len(one)] += n / (n + m) * np.array(one)
    out[: len(other)] += m / (n + m) * np.array(other)
    return tuple(out)


def exact_z(n_ref: int, n_alt: int, u: int) -> float:
    """The z at which a normal curve is as high as the exact chance of the rank sum; 0 where it is never as high."""
    scale = math.sqrt(n_ref * n_alt * (n_ref + n_alt + 1) / 12 * 2 * math.pi)
    p = rank_sum_distribution(n_alt, n_ref)[u] * scale
    return 0.0 if p >= 1 else math.copysign(math.sqrt(-2 * math.log(p)), 1 if 2 * u >= n_ref * n_alt else -1)


def distance_chance(distance: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Height of the curve of mean distances of ``n`` letters at ``distance``; -1 for fewer than two."""
    out = np.full(len(n), -1.0)
    two = n == 2
    d = distance[two]
    out[two] = np.where(d == 0, (2 * BINS + 4 * (BINS - 1)) / BINS**2, 8 * (BINS - 4 * d) / BINS**2)
    some = n > 2
    table = np.array(((0, 1), (0, 1), (0, 1), *SPREAD))
    few = n[some] < 24
    k = np.where(few, n[some], 3)
    mean = np.where(few, table[k, 0] * BINS / 100, BINS / 8)
    spread = np.where(few, table[k, 1] * BINS / 100 * 1.2, 1.476 / (0.182 * np.minimum(n[some], 100) ** 0.514) * BINS / 100)
    out[some] = np.exp(-0.5 * ((distance[some] - mean) / spread) ** 2) / (spread * math.sqrt(2 * math.pi))
    return out


def position_bias(sums: DataFrame, key=("tid", "pos")) -> DataFrame:
    """(key, n_ref, n_alt, rank_z, distance_bias) of ``place_sums``: ``rank_z`` is null without letters on both sides."""

    def run(batches):
        for pdf in batches:
            r, a, u = (pdf[c].to_numpy(np.int64) for c in ("n_ref", "n_alt", "u"))
            both = (r > 0) & (a > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                z = (u - (r * a + 1.0) / 2) / np.sqrt(r * a * (r + a + 1.0) / 12)
            for i in np.flatnonzero(both & (r < EXACT) & (a < EXACT)):
                z[i] = exact_z(int(r[i]), int(a[i]), int(u[i]))
            bias = distance_chance(pdf["distance"].to_numpy(float, na_value=0.0), a)
            yield pdf[[*key, "n_ref", "n_alt"]].assign(rank_z=pd.Series(np.where(both, z, np.nan)).astype(object).where(both, None), distance_bias=bias)

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", n_ref long, n_alt long, rank_z double, distance_bias double")
