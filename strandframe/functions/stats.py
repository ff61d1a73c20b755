"""Numeric kernels: special functions, exact tests, allele and haplotype frequencies, genotype likelihoods."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

LIKELIHOOD = 10.0 ** (-np.arange(256) / 10.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_q(a: float, x: float) -> float:
    return 1 - gamma_p(a, x)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float, float]:
    """(left, right, two-sided) probabilities of a 2 x 2 table; empty tables give 1."""
    r, s, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, r + s - n), min(r, s)
    logs = np.array([math.lgamma(r + 1) + math.lgamma(n - r + 1) + math.lgamma(s + 1) + math.lgamma(n - s + 1) - math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(r - k + 1) - math.lgamma(s - k + 1) - math.lgamma(n - r - s + k + 1) for k in range(lo, hi + 1)])
    p = np.exp(logs)
    own = p[a - lo]
    return min(1.0, float(p[: a - lo + 1].sum())), min(1.0, float(p[a - lo :].sum())), min(1.0, float(p[p <= own * (1 + 1e-7)].sum()))


def hwe_exact(hom_a: int, het: int, hom_b: int) -> float:
    """Exact Hardy-Weinberg test: summed probability of tables no likelier than the observed; 1 without data."""
    n = hom_a + het + hom_b
    if not n:
        return 1.0
    rare = 2 * min(hom_a, hom_b) + het
    hets = np.arange(rare % 2, rare + 1, 2)
    hr = (rare - hets) // 2
    hc = n - hets - hr
    logs = np.array([math.log(2) * h - math.lgamma(h + 1) - math.lgamma(r + 1) - math.lgamma(c + 1) for h, r, c in zip(hets, hr, hc, strict=True)])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    return min(1.0, float(p[p <= p[hets == het][0] * (1 + 1e-7)].sum()))


def t_test_less(n1, s1, q1, n2, s2, q2) -> float:
    """One-sided p that the first mean is smaller, from counts, sums and squares; 1 unless it is and both have spread."""
    if not n1 or not n2 or n1 + n2 <= 2:
        return 1.0
    u1, u2 = s1 / n1, s2 / n2
    if u1 <= u2:
        return 1.0
    v = (q1 - n1 * u1 * u1 + q2 - n2 * u2 * u2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)
    df = n1 + n2 - 2
    if v <= 0:
        return 0.0
    t = (u1 - u2) / math.sqrt(v)
    return 0.5 * beta_i(0.5 * df, 0.5, df / (df + t * t))


def allele_frequency(pl: np.ndarray, steps: int = 50, eps: float = 1e-5) -> float:
    """Frequency of the second allele by EM on PL triples (samples x 3) under Hardy-Weinberg, from 0.5... to eps."""
    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    f = 0.5
    for _ in range(steps):
        g = like * np.array([(1 - f) ** 2, 2 * f * (1 - f), f * f])
        new = float(((g[:, 1] + 2 * g[:, 2]) / g.sum(1)).sum() / (2 * len(like)))
        if abs(new - f) < eps:
            return new
        f = new
    return golden(lambda x: -log_likelihood(like, x), max(0.0, f - 0.05), min(1.0, f + 0.05))


def log_likelihood(like: np.ndarray, f: float) -> float:
    return float(np.log(np.maximum(like @ np.array([(1 - f) ** 2, 2 * f * (1 - f), f * f]), 1e-300)).sum())


def golden(fun, lo: float, hi: float, tol: float = 1e-7) -> float:
    """Minimum of a function in [lo, hi] by golden sections."""
    r = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    x, y = b - r * (b - a), a + r * (b - a)
    fx, fy = fun(x), fun(y)
    while b - a > tol:
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - r * (b - a)
            fx = fun(x)
        else:
            a, x, fx = x, y, fy
            y = a + r * (b - a)
            fy = fun(y)
    return (a + b) / 2


def genotype_frequencies(pl: np.ndarray, steps: int = 50, eps: float = 1e-5) -> np.ndarray:
    """Three genotype frequencies by EM without Hardy-Weinberg."""
    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    g = np.full(3, 1 / 3)
    for _ in range(steps):
        post = like * g
        new = (post / post.sum(1, keepdims=True)).mean(0)
        if np.abs(new - g).max() < eps:
            return new
        g = new
    return g


def hwe_lrt(pl: np.ndarray) -> float:
    """p of Hardy-Weinberg by the likelihood ratio of free and constrained genotype frequencies (1 df)."""
    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    free = float(np.log(np.maximum(like @ genotype_frequencies(pl), 1e-300)).sum())
    return gamma_q(0.5, max(0.0, free - log_likelihood(like, allele_frequency(pl))))


def group_lrt(pl: np.ndarray, first: np.ndarray) -> tuple[float, float]:
    """p of equal allele frequencies in two groups (1 df) and of equal genotype frequencies (2 df)."""
    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    if first.all() or not first.any():
        return 1.0, 1.0
    parts = [(like[m], pl[m]) for m in (first, ~first)]
    one = sum(log_likelihood(lk, allele_frequency(p)) for lk, p in parts) - log_likelihood(like, allele_frequency(pl))
    ll = lambda lk, g: float(np.log(np.maximum(lk @ g, 1e-300)).sum())
    two = sum(ll(lk, genotype_frequencies(p)) for lk, p in parts) - ll(like, genotype_frequencies(pl))
    return gamma_q(0.5, max(0.0, one)), gamma_q(1.0, max(0.0, two))


def frequencies_by_group(like: np.ndarray, groups: np.ndarray, steps: int = 50, eps: float = 1e-5) -> np.ndarray:
    """Allele frequency (sites x groups) of the samples of each group (groups x samples, boolean) by the EM of ``allele_frequency``, all sites and
    groups at a time; the few that do not settle end by golden sections."""
    size, f = 2 * groups.sum(1), np.full((len(like), len(groups)), 0.5)
    moving = np.ones(f.shape, bool)
    for _ in range(steps):
        g = like[:, None] * np.stack([(1 - f) ** 2, 2 * f * (1 - f), f * f], -1)[:, :, None]
        new = (((g[..., 1] + 2 * g[..., 2]) / g.sum(-1)) * groups).sum(-1) / size
        still = moving & (np.abs(new - f) >= eps)
        f, moving = np.where(moving, new, f), still
        if not moving.any():
            break
    for i, j in np.argwhere(moving):
        own = like[i][groups[j]]
        f[i, j] = golden(lambda x, own=own: -log_likelihood(own, x), max(0.0, f[i, j] - 0.05), min(1.0, f[i, j] + 0.05))
    return f


def group_statistics(like: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """(sites x groups) log likelihood ratio of one frequency for each group and its rest against one for all."""

    def total(own):
        f = frequencies_by_group(like, own)
        p = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f * f], -1)
        return (np.log(np.maximum((like[:, None] * p[:, :, None]).sum(-1), 1e-300)) * own).sum(-1)

    return total(groups) + total(~groups) - total(np.ones((1, groups.shape[1]), bool))


def shuffled_share(like: np.ndarray, group: np.ndarray, observed: np.ndarray, rounds: int, seed: int, enough: int = 10, step: int = 20) -> np.ndarray:
    """Share of shuffled groups whose statistic is as high as ``observed``, a site each. The shuffles are the same for all sites; a site stops once
    ``enough`` of them were as high, which settles its share well enough, and only the others go on."""
    rng = np.random.default_rng(seed)
    groups = np.array([rng.permutation(group) for _ in range(rounds)])
    high, done, left = np.zeros(len(like), int), np.zeros(len(like), int), np.arange(len(like))
    for k in range(0, rounds, step):
        as_high = group_statistics(like[left], groups[k : k + step]) >= observed[left, None] - 1e-9
        high[left] += as_high.sum(1)
        done[left] += as_high.shape[1]
        left = left[high[left] < enough]
        if not len(left):
            break
    return high / np.maximum(done, 1)


def haplotypes(pl_a: np.ndarray, pl_b: np.ndarray, steps: int = 50, eps: float = 1e-5) -> tuple[np.ndarray, float]:
    """Frequencies of the four haplotypes of two sites by EM over sample likelihoods, and r; r is -1 where undefined."""
    la, lb = LIKELIHOOD[np.clip(pl_a, 0, 255)], LIKELIHOOD[np.clip(pl_b, 0, 255)]
    fa, fb = allele_frequency(pl_a), allele_frequency(pl_b)
    f = np.array([(1 - fa) * (1 - fb), (1 - fa) * fb, fa * (1 - fb), fa * fb])
    alleles = [(0, 0), (0, 1), (1, 0), (1, 1)]
    for _ in range(steps):
        new, total = np.zeros(4), np.zeros(len(la))
        post = {}
        for i, (a1, b1) in enumerate(alleles):
            for j, (a2, b2) in enumerate(alleles):
                post[i, j] = f[i] * f[j] * la[:, a1 + a2] * lb[:, b1 + b2]
                total += post[i, j]
        total = np.maximum(total, 1e-300)
        for (i, j), p in post.items():
            x = (p / total).sum()
            new[i] += x
            new[j] += x
        new /= 2 * len(la)
        done = np.abs(new - f).max() < eps
        f = new
        if done:
            break
    p, q = f[2] + f[3], f[1] + f[3]
    den = p * (1 - p) * q * (1 - q)
    return f, float((f[0] * f[3] - f[1] * f[2]) / math.sqrt(den)) if den > 0 else -1.0


def haplotype_r(pl: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 50, eps: float = 1e-5, batch: int = 4096, freq: np.ndarray | None = None) -> np.ndarray:
    """r of ``haplotypes`` for pairs of rows ``a``, ``b`` of pl (sites x samples x 3), many pairs at a time; ``freq`` are the sites' allele
    frequencies if known."""
    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    freq, n = np.array([allele_frequency(x) for x in pl]) if freq is None else freq, pl.shape[1]
    geno = np.array([[3 * (a1 + a2) + b1 + b2 for a2, b2 in ((0, 0), (0, 1), (1, 0), (1, 1))] for a1, b1 in ((0, 0), (0, 1), (1, 0), (1, 1))])
    out = np.empty(len(a))
    for at in range(0, len(a), batch):
        i, j = a[at : at + batch], b[at : at + batch]
        g = (like[i][:, :, :, None] * like[j][:, :, None, :]).reshape(len(i), n, 9)
        fa, fb = freq[i], freq[j]
        f = np.stack([(1 - fa) * (1 - fb), (1 - fa) * fb, fa * (1 - fb), fa * fb], axis=1)
        live, cur, gl = np.arange(len(i)), f.copy(), g
        for _ in range(steps):
            w = np.zeros((len(live), 9))
            for x in range(4):
                for y in range(4):
                    w[:, geno[x, y]] += cur[:, x] * cur[:, y]
            share = (1 / np.maximum(gl @ w[:, :, None], 1e-300)).transpose(0, 2, 1) @ gl
            new = cur * (share[:, 0, :][:, geno] @ cur[:, :, None])[:, :, 0] / n
            done = np.abs(new - cur).max(1) < eps
            f[live] = cur = new
            if done.any():
                live, cur, gl = live[~done], cur[~done], gl[~done]
            if not len(live):
                break
        p, q = f[:, 2] + f[:, 3], f[:, 1] + f[:, 3]
        den = p * (1 - p) * q * (1 - q)
        out[at : at + batch] = np.where(den > 0, (f[:, 0] * f[:, 3] - f[:, 1] * f[:, 2]) / np.sqrt(np.where(den > 0, den, 1)), -1.0)
    return out


def genotype_em(pl: np.ndarray, steps: int = 50, eps: float = 1e-5) -> np.ndarray:
    """``genotype_frequencies`` of many sites (sites x samples x 3); a site rests once it moves by less than ``eps``."""
    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    g, live = np.full((len(like), 3), 1 / 3), np.arange(len(like))
    for _ in range(steps):
        post = like[live] * g[live][:, None, :]
        new = (post / post.sum(2, keepdims=True)).mean(1)
        moved = np.abs(new - g[live]).max(1) >= eps
        g[live] = new
        live = live[moved]
        if not len(live):
            break
    return g


def count_posterior(pl: np.ndarray, theta: float = 1e-3, prior: str = "full") -> np.ndarray:
    """Posterior of the number of second alleles among 2n chromosomes of one site."""
    return count_posteriors(pl[None], theta, prior)[0]


def count_likelihoods(pl: np.ndarray) -> np.ndarray:
    """Likelihood of each number of second alleles (sites x 2n + 1), the mean over the chromosomes that may have them, up to a factor of each
    site: samples are taken in one by one, all sites (sites x samples x 3) at a time."""
    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    n = like.shape[1]
    z = np.ones((len(like), 1))
    for j in range(n):
        m = 2 * (j + 1)
        k = np.arange(m + 1, dtype=float)
        wide = np.pad(z, ((0, 0), (2, 2)))  # column 2 + k holds count k of the samples before
        ways, before = ((m - k) * (m - k - 1), 2 * k * (m - k), k * (k - 1)), (wide[:, 2:], wide[:, 1:-1], wide[:, :-2])
        z = sum(w * like[:, j, g, None] * b for g, (w, b) in enumerate(zip(ways, before, strict=True))) / (m * (m - 1))
        z /= np.maximum(z.max(1, keepdims=True), 1e-300)
    return z


def count_posteriors(pl: np.ndarray, theta: float = 1e-3, prior="full") -> np.ndarray:
    """The same for many sites (sites x samples x 3)."""
    post = count_likelihoods(pl) * _count_prior(pl.shape[1], theta, prior)
    return post / _in_order(post)[:, None]


def expected_counts(pl: np.ndarray, theta: float = 1e-3, prior="full") -> tuple[np.ndarray, np.ndarray]:
    """Of many sites, the posterior that no second allele is there, and its expected number: sums are divided last, as the SQL does, so that both
    round to the same places."""
    post = count_likelihoods(pl) * _count_prior(pl.shape[1], theta, prior)
    total = _in_order(post)
    return post[:, 0] / total, _in_order(np.arange(post.shape[1]) * post) / total


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right; numpy's own sum adds in blocks, which differs in the last bits."""
    return np.cumsum(x, 1)[:, -1]


def count_interval(post: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Of posteriors by count, the first counts at which (1 - level) / 2 and 1 - (1 - level) / 2 of the whole are reached."""
    total = np.cumsum(post, 1)
    tail = (1 - level) / 2
    return (total >= tail).argmax(1), np.where((total >= 1 - tail).any(1), (total >= 1 - tail).argmax(1), post.shape[1] - 1)


def group_contrast(pl: np.ndarray, first: int, theta: float = 1e-3, prior="full") -> np.ndarray:
    """(sites x 3) posterior that the second allele is rarer, as frequent, or more frequent in the first ``first`` samples than in the rest: each
    pair of counts has the prior of its sum, shared among the ways to deal that sum to the two groups."""
    a, b = 2 * first, 2 * (pl.shape[1] - first)
    i, j = np.arange(a + 1)[:, None], np.arange(b + 1)[None, :]
    choose = np.vectorize(math.comb, otypes=[float])
    weight = choose(a, i) * choose(b, j) / choose(a + b, i + j) * _count_prior(pl.shape[1], theta, prior)[i + j]
    joint = count_likelihoods(pl[:, :first])[:, :, None] * count_likelihoods(pl[:, first:])[:, None, :] * weight
    joint /= joint.sum((1, 2), keepdims=True)
    side = np.sign(i * b - j * a)
    return np.stack([(joint * (side == k)).sum((1, 2)) for k in (-1, 0, 1)], 1)


def _count_prior(n: int, theta: float, prior) -> np.ndarray:
    """``full``, ``flat``, ``cond2``, or the 2n + 1 probabilities themselves."""
    if not isinstance(prior, str):
        own = np.asarray(prior, float)
        if own.shape != (2 * n + 1,) or (own < 0).any() or own.sum() <= 0:
            raise ValueError(f"a prior of {n} samples has {2 * n + 1} probabilities")
        return own / own.sum()
    k = np.arange(2 * n + 1)
    if prior == "flat":
        return np.ones(2 * n + 1)
    p = np.zeros(2 * n + 1)
    p[1:] = theta / k[1:]
    rest = theta * np.cumsum(np.append(0, 1 / k[1:]))[-1]
    if prior == "cond2":
        p = theta * (k + 1.0) / (2 * n + 1)
        rest = p[1:].sum()
    p[0] = max(1e-12, 1 - rest)
    return p


def trio_llr(pl: np.ndarray) -> tuple[int, int, int]:
    """(CLR, UGT, CGT) of father, mother, child PL triples: constrained less unconstrained best sum, and both genotypes packed by 2 bits."""
    best = pl.argmin(1)
    if (best == 0).all():
        return 0, 0, 0
    can = {(f, m): {a + b for a in ({0}, {0, 1}, {1})[f] for b in ({0}, {0, 1}, {1})[m]} for f in range(3) for m in range(3)}
    free = int(pl.min(1).sum())
    bound, gt = min((int(pl[0, f] + pl[1, m] + pl[2, c]), (f, m, c)) for (f, m), cs in can.items() for c in cs)
    pack = lambda t: int(t[0] | t[1] << 2 | t[2] << 4)
    return bound - free, pack(best), pack(gt)


#: Fixed values of the model of dependent errors: dependency and its floor, range of qualities, most bases of a pile.
DEPENDENCY, DEPENDENCY_FLOOR = 0.83, 0.03
QUALITIES = (4, 63)
MOST_BASES = 255
_PHRED = -10 / math.log(10)


@lru_cache(maxsize=1 << 14)
def error_costs(n: int, quality: int) -> np.ndarray:
    """Phred of P(more than k errors | at least k errors), k = 0..n-1, of ``n`` bases of one quality (binomial tails)."""
    k = np.arange(n + 1)
    log_rate, log_right = quality / _PHRED, math.log1p(-(10 ** (-quality / 10)))
    log_tail = np.logaddexp.accumulate((log_choose(n, k) + k * log_rate + (n - k) * log_right)[::-1])[::-1]
    return _PHRED * np.diff(log_tail)


def log_choose(n, k) -> np.ndarray:
    """log of the binomial coefficient of small non-negative integers."""
    n, k = np.asarray(n), np.asarray(k)
    return _LOG_FACTORIAL[n] - _LOG_FACTORIAL[k] - _LOG_FACTORIAL[n - k]


_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * MOST_BASES + 1)))])


def earlier_equal(key: np.ndarray) -> np.ndarray:
    """For every entry the number of equal entries before it."""
    order = np.argsort(key, kind="stable")
    ranked, place = key[order], np.arange(len(key))
    run_start = np.maximum.accumulate(np.where(np.diff(ranked, prepend=-1) != 0, place, 0))
    out = np.empty(len(key), np.int64)
    out[order] = place - run_start
    return out


def pile_costs(pile, seed: int = 0) -> np.ndarray:
    """5 x 5 phred costs of the genotypes of a pile of (base 0-4, quality, strand).

    Bases come best first. The k-th one like it on its strand counts DEPENDENCY ** k of an independent error, down to
    a floor; every base outside a genotype is an error, and a heterozygous one adds the binomial cost of its split.
    Beyond MOST_BASES bases a seeded sample is used, as the model is defined for 8-bit counts."""
    rows = np.array(pile, np.int64).reshape(-1, 3)
    if len(rows) > MOST_BASES:
        rows = rows[np.sort(np.random.default_rng(seed).permutation(len(rows))[:MOST_BASES])]
    if not len(rows):
        return np.zeros((5, 5))
    base, quality, strand = rows[:, 0], rows[:, 1].clip(*QUALITIES), rows[:, 2]
    best_first = np.lexsort([base, strand, -quality])
    base, quality, strand = base[best_first], quality[best_first], strand[best_first]
    share = DEPENDENCY ** earlier_equal(2 * base + strand) * (1 - DEPENDENCY_FLOOR) + DEPENDENCY_FLOOR
    nth = earlier_equal(base)
    cost = share * [error_costs(len(base), q)[k] for q, k in zip(quality.tolist(), nth.tolist(), strict=True)]
    error, count = np.bincount(base, cost, 5), np.bincount(base, minlength=5)
    one, two = np.indices((5, 5))
    outside = (np.arange(5)[:, None, None] != one) & (np.arange(5)[:, None, None] != two)
    pair = count[one] + count[two]
    split = np.where(one == two, 0.0, _PHRED * (log_choose(pair, np.minimum(count[two], pair)) - pair * math.log(2)))
    return np.maximum(np.einsum("k,kij->ij", error, outside) + split, 0.0)


def best_alleles(pl: np.ndarray, alleles: int, largest: int = 3, p_value: float = 0.99) -> tuple[tuple[int, ...], float]:
    """(alleles kept, phred quality) of a multi-allelic site from PL (samples x A(A+1)/2, order (0,0),(0,1),(1,1),..).

    For each set of up to ``largest`` alleles, frequencies come from EM under Hardy-Weinberg. A larger set is taken
    only if its likelihood gain passes a chi-squared test with one degree of freedom per added allele."""
    from itertools import combinations

    like = LIKELIHOOD[np.clip(pl, 0, 255)]
    index = {(a, b): b * (b + 1) // 2 + a for b in range(alleles) for a in range(b + 1)}

    def fit(kept):
        f = np.full(len(kept), 1 / len(kept))
        ll = -np.inf
        for _ in range(50):
            total, share = np.zeros(len(like)), np.zeros((len(kept), len(like)))
            for i, a in enumerate(kept):
                for j, b in enumerate(kept[i:], i):
                    p = f[i] * f[j] * (1 if i == j else 2) * like[:, index[min(a, b), max(a, b)]]
                    total += p
                    share[i] += p
                    share[j] += p
            total = np.maximum(total, 1e-300)
            new = (share / total).sum(1) / (2 * len(like))
            now = float(np.log(total).sum())
            if abs(now - ll) < 1e-6:
                break
            f, ll = new, now
        return ll

    best, score = (0,), fit((0,))
    null = score
    for size in range(1, min(largest, alleles) + 1):
        top = max(((fit(k), k) for k in combinations(range(alleles), size)), key=lambda x: (x[0], tuple(-i for i in x[1])))
        added = size - len(best)
        if added == 0 and top[0] > score:
            score, best = top
        elif added > 0 and gamma_p(added / 2, max(0.0, top[0] - score)) > p_value:
            score, best = top
    if best == (0,):
        others = max((fit((0, k)) for k in range(1, alleles)), default=null)
        qual = 4.343 * max(0.0, null - others) + 1
    else:
        qual = 4.343 * max(0.0, score - null)
    return best, min(999.0, qual)


IUPAC_OF = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def call_genotype(pl: np.ndarray, kept: tuple[int, ...]) -> tuple[tuple[int, int], int]:
    """((a, b), GQ up to 99) of one sample among the kept alleles."""
    ranked = sorted((int(pl[max(a, b) * (max(a, b) + 1) // 2 + min(a, b)]), (a, b)) for i, a in enumerate(kept) for b in kept[i:])
    return ranked[0][1], min(99, ranked[1][0] - ranked[0][0]) if len(ranked) > 1 else 99
