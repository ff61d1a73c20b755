"""All links of the set join, inside groups of near copies too, against brute force."""

import random
from collections import Counter

from strandframe.llm import jaccard_join


def test_link_counts(spark):
    rng = random.Random(5)
    rows = []
    for g, n in enumerate((8, 14, 60, 300)):
        base = [f"w{g}x{rng.randrange(10_000)}" for _ in range(n)]
        for k in range(12):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(n)] = f"new{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(words[: n - k % 3])))
    rows += [(900, rows[0][1]), (901, ""), (902, None), (903, "two words"), (904, "two words"), (None, rows[30][1])]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    link = lambda x, y: bool(x) and 4 * len(x & y) >= 3 * len(x | y)
    want = Counter((d, len(s), sum(link(s, o) for j, o in enumerate(sets) if i != j)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert max(n for _, _, n in want) > 8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.link_counts(docs).collect())) == want
