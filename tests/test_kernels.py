import math
import random
from itertools import product

import numpy as np
import pytest

from strandframe.functions import codec, search, stats


def aligned(rng, base):
    r, s = [], []
    for c in base:
        z = rng.random()
        if z < 0.05:
            r.append("-"), s.append(rng.choice("ACGTN"))
        if z < 0.1:
            r.append(c), s.append("-")
        else:
            r.append(c), s.append(rng.choice("ACGTN") if z < 0.2 else c)
    for _ in range(rng.randint(0, 3)):
        r.append("-"), s.append("A")
    return "".join(r), "".join(s)


def test_codec_round_trip():
    rng = random.Random(3)
    for _ in range(150):
        base = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 250)))
        rows = [(f"s{k}", *aligned(rng, base)) for k in range(rng.randint(1, 4))]
        data, per = codec.compress(rows, rng.choice([0, 1, 20, 200]))
        assert codec.decompress(data, [base] * len(rows)) == [(n, s.replace("-", "")) for n, _, s in rows]
        assert all(p["matches"] + p["replaces"] + p["insertions"] == len(s.replace("-", "")) for p, (_, _, s) in zip(per, rows))


def test_codec_shares_phrases():
    base = "".join(random.Random(1).choice("ACGT") for _ in range(3000))
    one, _ = codec.compress([("a", base, base)])
    two, _ = codec.compress([("a", base, base), ("b", base, base)])
    assert len(two) - len(one) < 40


@pytest.mark.parametrize("bad", [("ACX", "ACG"), ("AC", "ACG")])
def test_codec_errors(bad):
    with pytest.raises(ValueError):
        codec.compress([("a", bad[1] if len(bad[0]) == 3 else bad[0], bad[0] if len(bad[0]) == 3 else bad[1])])


def test_bits():
    w = codec.BitWriter()
    for n in range(1, 600):
        w.delta(n), w.gamma(n)
    r = codec.BitReader(w.bytes())
    assert all(r.delta() == n and r.gamma() == n for n in range(1, 600))
    with pytest.raises(ValueError):
        w.delta(0)


def test_search_algorithms_agree():
    rng = random.Random(5)
    for _ in range(300):
        s = "".join(rng.choice("AACGN") for _ in range(rng.randint(0, 120)))
        p = "".join(rng.choice("AACGN") for _ in range(rng.randint(1, 5)))
        want = [i for i in range(len(s) - len(p) + 1) if s[i : i + len(p)] == p]
        assert search.find(s, p) == search.find_dfa(s, p) == search.find_horspool(s, p) == search.find_signature(s, p, 7) == want
    assert search.find_dfa("AAAAA", "aAa") == [0, 1, 2]


def test_transfer_is_associative():
    rng = np.random.default_rng(2)
    t = search.automaton("ACA")
    a, b, c = (search.Transfer.of(t, rng.integers(0, 5, 20).astype(np.uint8)) for _ in range(3))
    x, y = a.then(b).then(c), a.then(b.then(c))
    assert (x.to == y.to).all() and (x.hits == y.hits).all()


def test_hwe_and_fisher_by_enumeration():
    from math import comb, factorial

    def hwe(a, h, b):
        n, na = a + h + b, 2 * a + h
        p = {}
        for het in range(na % 2, min(na, 2 * n - na) + 1, 2):
            x, y = (na - het) // 2, (2 * n - na - het) // 2
            p[het] = 2**het / (factorial(x) * factorial(het) * factorial(y))
        s = sum(p.values())
        return sum(v for v in p.values() if v <= p[h] * (1 + 1e-9)) / s

    for a, h, b in product(range(5), repeat=3):
        if a + h + b:
            assert stats.hwe_exact(a, h, b) == pytest.approx(hwe(a, h, b))
    assert stats.hwe_exact(0, 0, 0) == 1
    for a, b, c, d in product(range(4), repeat=4):
        r, s, n = a + b, a + c, a + b + c + d
        p = {k: comb(r, k) * comb(n - r, s - k) / comb(n, s) for k in range(max(0, r + s - n), min(r, s) + 1)}
        left, right, two = stats.fisher(a, b, c, d)
        assert left == pytest.approx(sum(v for k, v in p.items() if k <= a))
        assert right == pytest.approx(sum(v for k, v in p.items() if k >= a))
        assert two == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-9)))


def test_special_functions():
    assert stats.gamma_p(1, 2) == pytest.approx(1 - np.exp(-2))
    assert stats.gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert stats.beta_i(2, 3, 0.4) == pytest.approx(0.5248)
    assert stats.t_test_less(5, 50, 510, 5, 25, 135) < 0.05


def test_frequencies_recover_truth():
    rng = np.random.default_rng(4)
    g = rng.binomial(2, 0.3, 400)
    pl = np.full((400, 3), 60)
    pl[np.arange(400), g] = 0
    assert stats.allele_frequency(pl) == pytest.approx(g.sum() / 800, abs=1e-3)
    assert stats.genotype_frequencies(pl) == pytest.approx(np.bincount(g, minlength=3) / 400, abs=1e-3)
    assert stats.haplotypes(pl, pl)[1] == pytest.approx(1, abs=0.05)
    post = stats.count_posterior(pl[:20], prior="flat")
    assert post.argmax() == g[:20].sum()


def test_trio_and_error_model():
    assert stats.trio_llr(np.array([[0, 9, 9], [0, 9, 9], [0, 9, 9]])) == (0, 0, 0)
    clr, ugt, cgt = stats.trio_llr(np.array([[0, 50, 90], [0, 50, 90], [50, 0, 60]]))
    assert clr == 50 and ugt != cgt
    lk = stats.pile_costs([(0, 30, 0)] * 10 + [(2, 30, 1)] * 10)
    assert lk[0, 2] == lk.min()
    assert stats.pile_costs([(1, 30, 0)] * 12)[1, 1] == 0
    assert (stats.pile_costs([]) == 0).all()


def test_error_costs_are_binomial_tails():
    e = 10 ** -1.7
    tail = [sum(math.comb(9, j) * e**j * (1 - e) ** (9 - j) for j in range(k, 10)) for k in range(10)]
    assert stats.error_costs(9, 17) == pytest.approx([-10 * math.log10(tail[k + 1] / tail[k]) for k in range(9)])
    assert stats.pile_costs([(3, 17, 0)])[0, 0] == pytest.approx(17)
    assert stats.pile_costs([(3, 17, 0), (0, 40, 1)])[0, 3] == pytest.approx(-10 * math.log10(2 / 4))


def test_phrase_search_is_the_search_of_the_text():
    rng = random.Random(8)
    for sync in (0, 7):
        rows = [(str(k), *aligned(rng, [rng.choice("ACGT") for _ in range(120)])) for k in range(6)]
        data, _ = codec.compress(rows, sync)
        refs = [r.replace("-", "") for _, r, _ in rows]
        names, trie, codes = codec.load(data, refs)
        assert names == [n for n, _, _ in rows]
        for pattern in ("A", "AC", "ACA", "NNA", "ACGTA", "G" * 9):
            s = search.PhraseSearch(pattern, *(np.array(x) for x in (trie.parent, trie.symbol, trie.length)))
            for (_, text), found in zip(codec.decompress(data, refs), codes, strict=True):
                assert s.find(found) == search.find(text, pattern)
                assert sum(trie.length[c] for c in found) == len(text)
