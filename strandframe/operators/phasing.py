"""What follows the phase of sites: fragments take a side, chimeras are cut, sites are counted by side, doubtful stretches are masked, reads split.

All of it is windows and aggregates; ``calling.phase_sets`` finds the phases. Observations are (tid, frag, pos, allele 0/1), sites
(tid, ps, pos, phase), where ps names the set of sites that fragments link.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .sweep import tiled_cumsum, tiled_max

#: Cost of a site that a cut leaves on the wrong side, sites that a cut must gain, and sites that each side must have.
PENALTY, GAIN, EACH = 2, 4, 3
#: Least sum of a masked stretch.
MASKED = 3


def sides(observations: DataFrame, sites: DataFrame) -> DataFrame:
    """(tid, ps, frag, pos, same): whether a fragment's letter is that of the first haplotype."""
    return observations.join(sites.select("tid", "ps", "pos", "phase"), ["tid", "pos"]).select("tid", "ps", "frag", "pos", (F.col("allele") == F.col("phase")).alias("same"))


def fragment_phases(observations: DataFrame, sites: DataFrame, repair: bool = True) -> DataFrame:
    """(tid, ps, frag, n, phase, agree, differ, phased, ambiguous, cut, tail): the side of each fragment within a set, 0 where more sites speak for
    the first haplotype than against it, else 1.

    A fragment of ``EACH`` sites or more on either side may be two molecules: of all cuts, one that makes head and tail change sides counts
    what then agrees, less ``PENALTY`` for each tail site that then does not; the best one (the first on ties) is taken if it beats both
    sides by ``GAIN``. ``cut`` is then the last position of the head, and ``tail`` says that the tail changes sides, else the head does. One
    sort by fragment and position; a fragment's sites are as many as a read pair spans."""
    rows = sides(observations, sites)
    key = ["tid", "ps", "frag"]
    whole, so_far = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n0, n = F.count_if("same").over(whole), F.count(F.lit(1)).over(whole)
    rows = rows.withColumns({"_n0": n0, "_n": n}).withColumn("_phase", F.when(2 * F.col("_n0") > F.col("_n"), 0).otherwise(1))
    own = F.col("same") == (F.col("_phase") == 0)  # agrees with the fragment's own side
    left = F.count_if(own).over(so_far)
    k = F.count(F.lit(1)).over(so_far)
    agree = F.when(F.col("_phase") == 0, F.col("_n0")).otherwise(F.col("_n") - F.col("_n0"))
    rows = rows.withColumns({"_left": left, "_k": k, "_agree": agree})
    tail_same = F.col("_agree") - F.col("_left")
    tail_other = F.col("_n") - F.col("_k") - tail_same
    rows = rows.withColumns({"_tail": F.col("_left") + tail_other - PENALTY * tail_same, "_head": F.col("_k") - F.col("_left") + tail_same - PENALTY * tail_other})
    worth = F.when(F.col("_k") < F.col("_n"), F.greatest("_tail", "_head"))
    best = F.max(F.struct(worth.alias("w"), (-F.col("pos")).alias("p"), (F.col("_tail") > F.col("_head")).alias("t")))
    g = rows.groupBy(*key).agg(F.first("_n").alias("n"), F.first("_phase").alias("phase"), F.first("_agree").alias("agree"), best.alias("_b")).withColumn("differ", F.col("n") - F.col("agree"))
    doubt = (F.col("agree") > 0) & (F.col("differ") > 0) & (F.col("differ") < 3) & (F.col("agree") <= F.col("differ") + 1)
    cut = F.lit(repair) & (F.least("agree", "differ") >= EACH) & (F.col("_b.w") - F.greatest("agree", "differ") >= GAIN)
    return g.select(
        *key, "n", "phase", "agree", "differ", (F.col("agree") != F.col("differ")).alias("phased"), doubt.alias("ambiguous"),
        F.when(cut, -F.col("_b.p")).alias("cut"), F.when(cut, F.col("_b.t")).alias("tail"),
    )


def repaired(observations: DataFrame, fragments: DataFrame) -> DataFrame:
    """``observations`` with the letters of the wrong part of each cut fragment turned."""
    cuts = fragments.where("cut is not null").select("tid", F.col("frag"), "cut", "tail").groupBy("tid", "frag").agg(F.max(F.struct("cut", "tail")).alias("_c"))
    rows = observations.join(cuts, ["tid", "frag"], "left")
    turned = F.coalesce((F.col("pos") > F.col("_c.cut")) == F.col("_c.tail"), F.lit(False))
    return rows.withColumn("allele", F.when(turned, 1 - F.col("allele")).otherwise(F.col("allele"))).drop("_c")


def site_support(observations: DataFrame, sites: DataFrame, fragments: DataFrame) -> DataFrame:
    """(tid, ps, pos, first_agree, first_differ, second_agree, second_differ): sites of fragments with two sites or more, counted by the fragment's
    side and by whether the letter is that side's. Every site has a row."""
    rows = sides(observations, sites).join(fragments.where("n > 1").select("tid", "ps", "frag", F.col("phase").alias("_side")), ["tid", "ps", "frag"])
    agrees = F.col("same") == (F.col("_side") == 0)
    n = lambda side, ok: F.count_if((F.col("_side") == side) & (agrees if ok else ~agrees))
    names = ["first_agree", "first_differ", "second_agree", "second_differ"]
    counts = rows.groupBy("tid", "ps", "pos").agg(*[n(k // 2, k % 2 == 0).alias(c) for k, c in enumerate(names)])
    return sites.select("tid", "ps", "pos").join(counts, ["tid", "ps", "pos"], "left").fillna(0, names)


def doubt(support: DataFrame) -> DataFrame:
    """``support`` with ``score``: less than 0 where no letter differs, above it where most do."""
    differ, agree = F.col("first_differ") + F.col("second_differ"), F.col("first_agree") + F.col("second_agree")
    more = lambda side: F.greatest(F.col(f"{side}_differ") - F.col(f"{side}_agree"), F.lit(0))
    return support.withColumn("score", F.when(differ == 0, -agree).otherwise(differ - 1) + more("first") + more("second"))


def masked_regions(scores: DataFrame, least: int = MASKED) -> DataFrame:
    """(tid, ps, beg, end, score): stretches of sites (tid, ps, pos, score) whose sum is ``least`` or more, each from where a running sum that
    never falls below 0 leaves it, to its first highest place; what comes after that place starts anew. ``end`` is the last site.

    The running sum is the sum so far less the lowest sum so far, both taken in tiles (``sweep``), so a long set is many tasks. Each round
    takes the first stretch of every excursion; the sites behind it go into the next round. Rounds and their sums are written to the shared folder."""
    key, found, rows = ["tid", "ps"], [], scores.select("tid", "ps", "pos", "score").withColumn("_part", F.lit(0).cast("long"))
    part = [*key, "_part"]
    while True:
        sums = stored(tiled_cumsum(rows, part, "pos", ["score"]), "mask-sums")
        low = stored(tiled_max(sums.withColumn("_neg", -F.col("cum_score")), part, "pos", F.col("_neg"), "_low"), "mask-low")
        run = low.withColumn("_run", F.col("cum_score") - F.least(-F.col("_low"), F.lit(0)))
        # an excursion is named by the last place where the sum was 0
        named = tiled_max(run, part, "pos", F.when(F.col("_run") == 0, F.col("pos")), "_from").where("_run > 0")
        named = stored(named.withColumn("_from", F.coalesce("_from", F.lit(-(1 << 62)))), "mask-runs")
        top = named.groupBy(*part, "_from").agg(F.max(F.struct(F.col("_run").alias("s"), (-F.col("pos")).alias("p"))).alias("_t"), F.min("pos").alias("beg"))
        top = top.where(F.col("_t.s") >= least).select(*part, "_from", "beg", (-F.col("_t.p")).alias("end"), F.col("_t.s").alias("score"))
        top = stored(top, "mask-top")
        if top.isEmpty():
            break
        found.append(top.select(*key, "beg", "end", "score"))
        rest = named.join(top.select(*part, "_from", F.col("end").alias("_end")), [*part, "_from"]).where(F.col("pos") > F.col("_end"))
        rows = stored(rest.select(*key, "pos", "score", F.xxhash64("_part", "_from").alias("_part")), "mask-rest")
    if found:
        return reduce(DataFrame.unionByName, found)
    return scores.select("tid", "ps", F.col("pos").alias("beg"), F.col("pos").alias("end"), F.col("score")).where("false")


def split_reads(reads: DataFrame, fragments: DataFrame, drop_ambiguous: bool = False, seed: int = 11) -> DataFrame:
    """``reads`` (tid, frag, ..) with ``part``: 0 or 1 for the haplotypes, 2 for chimeras (and, if asked for, ambiguous fragments), and a side by
    a hash of fragment and ``seed`` for those without a side; ``phased`` is true for a side that sites gave."""
    own = fragments.groupBy("tid", "frag").agg(F.max(F.struct("n", "phase", "phased", "ambiguous", (F.col("cut").isNotNull()).alias("chimera"))).alias("_f"))
    coin = F.pmod(F.xxhash64("frag", F.lit(seed)), F.lit(2)).cast("int")
    has = F.col("_f").isNotNull()
    given = has & F.col("_f.phased") & ~F.col("_f.ambiguous") & ~F.col("_f.chimera")
    bad = has & ((F.col("_f.phased") & ~F.col("_f.ambiguous") & F.col("_f.chimera")) | (F.lit(drop_ambiguous) & F.col("_f.ambiguous")))
    part = F.when(F.coalesce(bad, F.lit(False)), 2).when(F.coalesce(given, F.lit(False)), F.col("_f.phase")).otherwise(coin)
    return reads.join(own, ["tid", "frag"], "left").withColumns({"part": part, "phased": F.coalesce(given, F.lit(False))}).drop("_f")
