"""Mined rules against an enumeration of all token combinations, and urls on which listing them all has no end."""

import math
import random
import re
import time
from itertools import combinations

import pytest

from strandframe.llm import url_filter as U


def tokens(url):
    m = re.match(r"[^:]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    host, path, query = m[1].lower(), m[2], m[3] or ""
    words = [w for w in re.split(r"[^a-zA-Z0-9]+", path) if w and not w.isdigit()]
    return frozenset([f"h:{x}" for x in host.split(".") if x] + [f"p:{w.lower()}" for w in words] + [f"q:{k.split('=')[0]}" for k in query.split("&") if k.split("=")[0]])


def brute(urls, bad, min_count, confidence, surprise=0.0):
    """All smallest rules, over closed items: every subset of the tokens of every url."""
    sets, total, p = [tokens(u) for u in urls], len(urls), sum(bad) / len(urls)
    where = {t: frozenset(i for i, s in enumerate(sets) if t in s) for t in set().union(*sets)}
    classes = {}
    for t, rows in where.items():
        classes.setdefault(rows, []).append(t)
    items = {min(ts): rows for rows, ts in classes.items()}
    member = {min(ts): sorted(ts) for ts in classes.values()}
    rules = {}
    for k in range(1, 5):
        for combo in combinations(sorted(items), k):
            rows = frozenset.intersection(*(items[c] for c in combo))
            n, b = len(rows), sum(bad[i] for i in rows)
            if b >= min_count and b >= n * confidence and (not surprise or (b - n * p) >= surprise * math.sqrt(n * p * (1 - p))) and n < total:
                if not any(set(r) < set(combo) for r in rules):
                    rules[combo] = (b / n, b / total)
    return {tuple(sorted(t for c in r for t in member[c])): v for r, v in rules.items()}


def mined(spark, urls, bad, **kw):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    return U.mine_rules(pages, labels, **kw)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("lattice,surprise", [(U.LATTICE, 0.0), (0, 0.0), (U.LATTICE, 5.0), (0, 5.0)])
def test_rules_are_all_smallest_combinations(spark, seed, lattice, surprise):
    rng = random.Random(seed)
    urls, bad = [], []
    for _ in range(500):
        host = rng.choice(["a.org", "b.org", "www.a.org", "x.net"])
        words = rng.sample(["buy", "now", "news", "tag", "story"], rng.randint(0, 3))
        url = f"http://{host}/{'/'.join(words)}" + rng.choice(["", "?ref=1", "?ref=2&page=3"])
        t = tokens(url)
        risk = 0.95 if {"p:buy", "p:now"} <= t or {"h:x", "p:tag"} <= t else 0.9 if {"q:page", "h:www", "p:news"} <= t else 0.1
        urls.append(url), bad.append(int(rng.random() < risk))
    want = brute(urls, bad, U.MIN_COUNT, U.MIN_CONFIDENCE, surprise)
    got = {tuple(r["tokens"]): (r["confidence"], r["support"]) for r in mined(spark, urls, bad, lattice=lattice, min_surprise=surprise).collect()}
    assert got.keys() == want.keys() and len(got) >= 2
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_repeated_and_nested_long_urls(spark):
    """Equal urls of 30 path words, and a chain of paths each one word longer: listing all combinations has no end."""
    words = [f"w{k}x" for k in range(30)]
    urls = ["http://spam.bad.example.org/" + "/".join(words)] * 12 + [f"http://ok.org/{'/'.join(words[: k % 30])}" for k in range(300)]
    bad = [1] * 12 + [0] * 300
    for k in range(300):
        if k % 30 > 20 and k % 3:
            bad[12 + k] = 1
    start = time.time()
    out = mined(spark, urls, bad)
    rules = {tuple(r["tokens"]): r for r in out.collect()}
    assert time.time() - start < 60
    # the repeated url: the tokens only it has, as one item
    assert ("h:bad", "h:example", "h:spam", "p:w29x") in rules
    assert not any(set(a) < set(b) for a in rules for b in rules)
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls[:13])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages, out).collect()}
    assert got == dict.fromkeys(range(12), "block") | {12: "allow"}


def test_no_rule_without_surprise(spark):
    rng = random.Random(4)
    urls = [f"http://h{rng.randrange(60)}.org/{rng.choice('abcdefgh')}x" for _ in range(600)]
    assert mined(spark, urls, [int(rng.random() < 0.13) for _ in urls], min_surprise=5.0).count() == 0
