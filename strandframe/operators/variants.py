"""Site statistics over genotype likelihoods; kernels run per Arrow batch of sites, never per row in Python UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as K
from .sweep import TILE, islands


def _matrix(pl) -> np.ndarray:
    return np.array([list(t) for t in pl], np.int64)


def _stack(column) -> np.ndarray:
    """Sites x samples x 3 of a column of PL triples; all sites have the same samples."""
    return np.array([_matrix(pl) for pl in column], np.int64).reshape(len(column), -1, 3)


def _once(fun, *columns) -> np.ndarray:
    """``fun`` of each row of integer columns, computed once for equal rows."""
    rows = np.stack([np.asarray(c, np.int64) for c in columns], 1)
    distinct, back = np.unique(rows, axis=0, return_inverse=True)
    return np.array([fun(*map(int, r)) for r in distinct], float)[back.ravel()] if len(rows) else np.zeros(0)


def site_frequencies(sites: DataFrame) -> DataFrame:
    """(site, af, g0, g1, g2, hwe): allele frequency, genotype frequencies, Hardy-Weinberg p by likelihood ratio."""

    def run(batches):
        for pdf in batches:
            out = []
            for site, pl in zip(pdf["site"], pdf["pl"], strict=True):
                m = _matrix(pl)
                out.append((site, K.allele_frequency(m), *K.genotype_frequencies(m), K.hwe_lrt(m)))
            yield pd.DataFrame(out, columns=["site", "af", "g0", "g1", "g2", "hwe"])

    return sites.select("site", "pl").mapInPandas(run, "site long, af double, g0 double, g1 double, g2 double, hwe double")


def genotype_em(sites: DataFrame) -> DataFrame:
    """(site, g0, g1, g2): genotype frequencies by EM over the samples' likelihoods, a batch of sites at a time."""

    def run(batches):
        for pdf in batches:
            g = K.genotype_em(_stack(pdf["pl"]))
            yield pd.DataFrame({"site": pdf["site"], "g0": g[:, 0], "g1": g[:, 1], "g2": g[:, 2]})

    return sites.select("site", "pl").mapInPandas(run, "site long, g0 double, g1 double, g2 double")


def adjacent_ld(sites: DataFrame) -> DataFrame:
    """(site, r2): linkage of each site with the one before it (site - 1), by an equi-join and an EM kernel."""
    prev = sites.select((F.col("site") + 1).alias("site"), F.col("pl").alias("prev"))

    def run(batches):
        for pdf in batches:
            both = np.concatenate([_stack(pdf["prev"]), _stack(pdf["pl"])])
            k = np.arange(len(pdf))
            yield pd.DataFrame({"site": pdf["site"], "r2": K.haplotype_r(both, k, k + len(pdf)) ** 2})

    return sites.join(prev, "site").select("site", "prev", "pl").mapInPandas(run, "site long, r2 double")


def hwe_exact(genotypes: DataFrame) -> DataFrame:
    """(site, p) from counts (site, hom_a, het, hom_b)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"site": pdf["site"], "p": _once(K.hwe_exact, pdf["hom_a"], pdf["het"], pdf["hom_b"])})

    return genotypes.select("site", "hom_a", "het", "hom_b").mapInPandas(run, "site long, p double")


def strand_bias(tables: DataFrame) -> DataFrame:
    """(site, p) two-sided Fisher of (rf, rr, af, ar)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"site": pdf["site"], "p": _once(lambda *t: K.fisher(*t)[2], pdf["rf"], pdf["rr"], pdf["af"], pdf["ar"])})

    return tables.select("site", "rf", "rr", "af", "ar").mapInPandas(run, "site long, p double")


def count_posterior(sites: DataFrame) -> DataFrame:
    """(site, p_ref, ac): posterior that no second allele is there, and its expected number."""

    def run(batches):
        for pdf in batches:
            p_ref, ac = K.expected_counts(_stack(pdf["pl"]))
            yield pd.DataFrame({"site": pdf["site"], "p_ref": p_ref, "ac": ac})

    return sites.select("site", "pl").mapInPandas(run, "site long, p_ref double, ac double")


def count_interval(sites: DataFrame, level: float = 0.95, prior="full") -> DataFrame:
    """(site, low, high): interval of the number of second alleles that holds ``level`` of its posterior."""

    def run(batches):
        for pdf in batches:
            low, high = K.count_interval(K.count_posteriors(_stack(pdf["pl"]), prior=prior), level)
            yield pd.DataFrame({"site": pdf["site"], "low": low, "high": high})

    return sites.select("site", "pl").mapInPandas(run, "site long, low int, high int")


def group_contrast(sites: DataFrame, first: int, prior="full") -> DataFrame:
    """(site, less, equal, more): posterior that the second allele is rarer, as frequent or more frequent in the first ``first`` samples."""

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 500):  # a site takes a number for each pair of counts
                p = K.group_contrast(_stack(pdf["pl"][k : k + 500]), first, prior=prior)
                yield pd.DataFrame({"site": pdf["site"][k : k + 500], "less": p[:, 0], "equal": p[:, 1], "more": p[:, 2]})

    return sites.select("site", "pl").mapInPandas(run, "site long, less double, equal double, more double")


def read_prior(spark, path: str) -> list[float]:
    """Probabilities of the counts 0 to 2n, one a line; as many as there are chromosomes and one, so few enough for the driver."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("k"), F.trim("value").alias("v")).where("v <> ''").orderBy("k")
    return [float(r["v"].split()[-1]) for r in lines.collect()]


def genotype_counts(sites: DataFrame) -> DataFrame:
    """(site, hom_a, het, hom_b): samples by their likeliest genotype, the first on ties."""
    best = F.transform("pl", lambda t: F.array_position(t, F.array_min(t)))
    n = lambda k: F.size(F.filter(best, lambda b: b == k)).cast("long")
    return sites.select("site", n(1).alias("hom_a"), n(2).alias("het"), n(3).alias("hom_b"))


def pair_llr(sites: DataFrame) -> DataFrame:
    """(site, llr): for samples 1 and 2, the best sum of equal genotypes less the best free sum."""
    a, b = F.element_at("pl", 1), F.element_at("pl", 2)
    return sites.select("site", (F.array_min(F.zip_with(a, b, lambda x, y: x + y)) - F.array_min(a) - F.array_min(b)).cast("long").alias("llr"))


def likelihood_gaps(sites: DataFrame) -> DataFrame:
    """(gap, n): histogram of second-best less best likelihood of all samples."""
    gap = F.transform("pl", lambda t: F.element_at(F.array_sort(t), 2) - F.array_min(t))
    return sites.select(F.explode(gap).alias("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def allele_counts(sites: DataFrame) -> DataFrame:
    """(site, ac, an): allele counts of called samples; a sample of likelihoods 0,0,0 is not called."""
    called = F.filter("pl", lambda t: F.array_max(t) > 0)
    ac = F.aggregate(called, F.lit(0), lambda s, t: s + F.array_position(t, F.array_min(t)).cast("int") - 1)
    return sites.select("site", ac.cast("long").alias("ac"), (2 * F.size(called)).cast("long").alias("an"))


def quality_curve(sites: DataFrame) -> DataFrame:
    """(qual, n, ts, tv): running numbers of sites (qual, is_ts) from the highest quality down, one row per quality.
    Rows are summed per quality first, so the window sees distinct qualities only."""
    g = sites.groupBy("qual").agg(F.count(F.lit(1)).alias("k"), F.count_if("is_ts").alias("t"))
    w = Window.orderBy(F.col("qual").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.select("qual", F.sum("k").over(w).cast("long").alias("n"), F.sum("t").over(w).cast("long").alias("ts"), (F.sum("k").over(w) - F.sum("t").over(w)).cast("long").alias("tv"))


def var_filter(sites: DataFrame, snp_gap: int = 3, indel_gap: int = 10, min_qual: int = 10) -> DataFrame:
    """Site filter: low quality goes by itself; then, along each contig, of two indels within ``indel_gap`` the better stays, and a
    SNP within ``snp_gap`` of a kept indel goes. An indel that goes no longer suppresses others, so their pass is sequential:
    indels alone are cut into islands at wider gaps, and each island is one group. SNPs look up kept indels by windows.

    Needs (chrom, pos, qual, is_indel), one row for each (chrom, pos); adds ``filter`` (PASS, lowqual, near_indel, indel_pair)."""
    good = F.col("qual") >= min_qual
    indels = islands(sites.where(good & F.col("is_indel")).select("chrom", "pos", "qual"), ["chrom"], "pos", indel_gap)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, qual = pdf["pos"].to_numpy(), pdf["qual"].to_numpy()
        kept, last = np.ones(len(pos), bool), 0
        for i in range(1, len(pos)):
            if pos[i] - pos[last] > indel_gap:
                last = i
            elif qual[i] > qual[last]:
                kept[last], last = False, i
            else:
                kept[i] = False
        return pdf[["chrom", "pos"]].assign(_kept=kept)

    marks = indels.groupBy("chrom", "_island").applyInPandas(one, "chrom string, pos long, _kept boolean")
    s = sites.join(marks, ["chrom", "pos"], "left")
    own = F.floor(F.col("pos") / TILE)
    spread = s.withColumns({"_own": own, "_tile": F.explode(F.sequence(F.floor((F.col("pos") - snp_gap) / TILE), F.floor((F.col("pos") + snp_gap) / TILE)))})
    near = F.count_if("_kept").over(Window.partitionBy("chrom", "_tile").orderBy("pos").rangeBetween(-snp_gap, snp_gap)) > 0
    s = spread.withColumn("_near", near).where("_tile = _own")
    mark = F.when(~good, "lowqual").when(F.col("is_indel"), F.when(F.col("_kept"), "PASS").otherwise("indel_pair")).otherwise(F.when(F.col("_near"), "near_indel").otherwise("PASS"))
    return s.select("chrom", "pos", "qual", "is_indel", mark.alias("filter"))
