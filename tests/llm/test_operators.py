"""Operators against brute force, edge cases, and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import common, embedding_dups, exact_dedup, html_wrappers, jaccard_join, line_dedup, mixing, quality_bt, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)


@pytest.fixture
def mixed(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Sigma", "tau", "pi"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))), rng.choice(["a", "b", None])) for k in range(60)]
    rows += [(100, None, "a"), (101, "", None), (102, " \n\t\n", "b"), (103, rows[0][1], "a"), (103, rows[0][1], "a"), (None, rows[1][1], "b"), (104, "x" * 50_000 + "\n" + lines[0], "z"), (105, rows[0][1].replace("\n", " \t "), "b")]
    return rows


# --- 1


def brute_lines(rows):
    key = lambda x: line_dedup.line_key(x)
    big = lambda d: float("inf") if d is None else d
    least, holders = {}, {}
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                least[key(x)] = min(big(d), least.get(key(x), float("inf")))
    out = Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or least[key(x)] == big(d)]
        out[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_dedup(spark, mixed):
    assert Counter(map(tuple, line_dedup.line_digest(documents(spark, mixed)).collect())) == brute_lines(mixed)


def test_line_dedup_hot_line_over_many_partitions(spark):
    rows = [(k, f"the same licence line\nown line number {k:05d}\nThe Same Licence LINE ", "s") for k in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert Counter(map(tuple, line_dedup.line_digest(documents(spark, rows)).collect())) == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_dedup_keeps_columns(spark, mixed):
    docs = documents(spark, mixed).withColumn("bitmap", F.lit(1)).withColumn("d", F.lit("x"))
    out = line_dedup.dedup_lines(docs)
    assert out.schema == docs.schema and out.count() == len(mixed)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_bitmap():
    m = line_dedup.keep_bitmap(11, [0, 9])
    assert line_dedup.cut("\n".join("abcdefghijk"), m) == ("\n".join("bcdefghik"), 11, 2)


# --- 2


def brute_vectors(rows):
    ok = [(i, np.array(v, float) / np.abs(v).max()) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids = sorted({i for i, _, _ in rows if i is not None})
    links = {i: set() for i in ids}
    for i, x in ok:
        for j, y in ok:
            if i != j and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                links[i].add(j)
    comp = {}
    for i in ids:
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j), todo.append(j)
            comp |= dict.fromkeys(seen, min(seen))
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in ids}


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    out = []
    for k in range(n):
        v = rng.normal(size=dim) if k % 3 else centres[k % 6] + rng.normal(size=dim) * spread
        out.append((k, v.astype(float).tolist(), k % 4))
    return out


@pytest.mark.parametrize("dim,spread,block", [(8, 0.2, 40), (64, 0.05, 64), (3, 0.3, 4096)])
def test_embedding_links(spark, dim, spread, block):
    rows = vectors(dim, 240, dim, spread)
    rows += [(1000, None, 0), (1001, [0.0] * dim, 0), (1002, [float("nan")] * dim, 0), (1003, [1.0] * (dim + 1), 0), (1004, [1.0] * (dim + 1), 0), (1005, [], 0), (1006, [None] * dim, 0), (0, rows[0][1], 9), (None, rows[0][1], 0), (1007, [x * 1e200 for x in rows[3][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(3))
    got = embedding_dups.near_duplicates(df, block=block).collect()
    assert len(got) == len(rows)
    want = brute_vectors(rows)
    for r in got:
        assert r["vec_id"] is None and not r["kept"] or (r["n_links"], r["component_id"], r["kept"]) == want[r["vec_id"]]


def test_cover_tree_bounds():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(200, 4)) * 0.03 for c in rng.normal(size=(5, 4))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embedding_dups.cover_tree(x, leaf=16)
    assert tree.kids and sorted(np.concatenate([n.rows for n in embedding_dups.leaves(tree)])) == list(range(len(x)))
    todo = [tree]
    while todo:
        n = todo.pop()
        assert np.linalg.norm(x[n.rows] - n.centre, axis=1).max() <= n.radius + 1e-7
        assert all(k.radius <= n.radius / 2 + 1e-7 for k in n.kids)
        todo += n.kids
    pairs = sum(len(a) * len(b) for a, b in embedding_dups.dual_traversal(tree, tree, 0.05))
    assert pairs < 0.5 * len(x) ** 2


def test_copies_and_structure(spark):
    """A vector held by a third of all ids, ids of several vectors, and clusters that the upper levels tell apart."""
    rng = np.random.default_rng(3)
    rows = [(k, [1.0, 2.0, 3.0, 4.0], 0) for k in range(300)]
    centres = rng.normal(size=(12, 4))
    rows += [(1000 + k, (centres[k % 12] + rng.normal(size=4) * 0.02).tolist(), 0) for k in range(600)] + [(2000, centres[0].tolist(), 0)] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dups.near_duplicates(df, block=25, group=2).collect()
    want = brute_vectors(rows)
    assert len(got) == len(rows) and all((r["n_links"], r["component_id"], r["kept"]) == want[r["vec_id"]] for r in got)
    two = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.01], 0), (4, [-1.0, 0.0], 0)]
    got = {r["vec_id"]: tuple(r)[1:3] for r in embedding_dups.near_duplicates(spark.createDataFrame(two, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (1, 1), 3: (1, 1), 4: (0, 4)}


def test_upper_levels_prune():
    """Counted: the walk over nested levels leaves few pairs of cells, each pair within reach among them, and group pairs hold all near blocks."""
    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(size=(300, 6)) * 0.01 for c in rng.normal(size=(40, 6))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embedding_dups.cover_tree(x[rng.permutation(len(x))[:2048]])
    assert any(k.kids for k in tree.kids)
    cell, gap = embedding_dups.cells_of(x, tree)
    own = embedding_dups.leaves(tree)
    embedding_dups.cover(tree, {id(n): float(gap[cell == i].max()) if (cell == i).any() else -1.0 for i, n in enumerate(own)})
    grid = embedding_dups.Grid(tree, [int((cell == i).sum()) for i in range(len(own))], 0.05, 128, 3)
    near = set(grid.cells)
    i, j = np.nonzero(np.triu(x @ x.T >= 1 - 0.05**2 / 2))
    assert all((min(a, b), max(a, b)) in near for a, b in zip(cell[i], cell[j], strict=True))
    pairs = sum(int((cell == a).sum()) * int((cell == b).sum()) for a, b in near)
    assert pairs < 0.2 * len(x) ** 2 / 2
    block = grid.block_of(cell, np.arange(len(x)))
    for a, b in zip(block[i][::97], block[j][::97], strict=True):
        g, h = sorted((int(a) // 3, int(b) // 3))
        assert h in grid.near[g] and (min(a, b), max(a, b)) in grid.block_pairs(g, h)


def test_probe_refutes_no_link():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + rng.normal(size=(150, 64)) * 0.33
    x /= np.linalg.norm(x, axis=1)[:, None]
    at = np.arange(300)
    full = embedding_dups.pairs_of(x, None, at, at, 0.95)
    probed = embedding_dups.pairs_of(x, embedding_dups.Probe(x, np.arange(16)), at, at, 0.95)
    assert sorted(zip(*full, strict=True)) == sorted(zip(*probed, strict=True)) and 300 < len(full[0]) < 600


# --- 3


def test_archives(spark):
    rows = [(k, f"http://h{k % 3}.example.org/p{k}?q=1", f"<p>payload {k % 4} é</p>") for k in range(40)]
    rows += [(90, None, None), (91, "nothing", ""), (92, "https://h.example.org:8443/a\tb", None), (93, "http://h0.example.org/p0?q=1", "x" * 300_000), (94, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit("?"))
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(p, last.get(h or "", -1))
    assert len(got) == len(rows)
    for p, _, h in rows:
        body = (h or "").encode()
        r = got[p]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), warc.digest(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == p else ("revisit", last[h or ""]))


def test_lookup(spark):
    rows = [(k, f"http://www{k % 7}.example.net/{k % 50:03d}", f"body {k}") for k in range(400)]
    scratch = common.Scratch(spark, "t")
    d = warc.build_index(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch), scratch, block=16)
    assert d.count() >= 25
    wanted = [rows[3][1], rows[200][1], "http://none.example.net/"]
    got = {(r["page_id"], r["payload"]) for r in warc.lookup(spark, d, wanted).collect()}
    assert got == {(k, h) for k, u, h in rows if u in wanted}


def test_search_reads_few_blocks(spark, tmp_path):
    """Counted: a key reads its own blocks only; a key over many blocks and files gives every capture once."""
    rows = [(k, f"http://h{k % 90}.example.net/{k:04d}", "x") for k in range(900)] + [(2000 + k, "http://hot.example.net/", f"y{k}") for k in range(300)] + [(3000, None, "z")]
    scratch = common.Scratch(spark, "t")
    d = warc.build_index(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch), scratch, block=16)
    blocks = d.collect()
    first = blocks[0]
    run = warc.Run(warc._Reader(), first["file"], first["dir_offset"], first["dir_length"])
    assert list(run.first) == [r["first_key"] for r in blocks if r["file"] == first["file"]]
    assert [v[0] for v in run.captures(run.first[3])] and run.reads <= 2
    assert list(run.captures("zzz")) == [] and run.reads <= 2
    asked = spark.createDataFrame([("http://hot.example.net/",), ("http://hot.example.net/",), (None,), ("http://none/",)], "url string")
    got = sorted(r["page_id"] for r in warc.records_of(warc.search(d, asked)).collect())
    assert got == [*range(2000, 2300), 3000]
    everything = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(repr, warc.records_of(warc.search(d, everything)).collect())) == sorted(map(repr, warc.read_archives(d).collect()))


def test_archives_of_repeated_and_null_ids(spark):
    rows = [(1, "http://a/", "same"), (1, "http://a/", "same"), (None, "http://b/", "same"), (None, None, "only null"), (2, "http://c/", "other"), (2, "http://c/", "different"), (3, "http://a/", "other")]
    got = Counter(map(tuple, warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    sha = lambda t: warc.digest(t.encode())
    want = Counter({(1, 4, sha("same"), "response", None): 2, (None, 4, sha("same"), "revisit", 1): 1, (None, 9, sha("only null"), "response", None): 1})
    want += Counter({(2, 5, sha("other"), "revisit", 3): 1, (2, 9, sha("different"), "response", None): 1, (3, 5, sha("other"), "response", None): 1})
    assert got == want


def test_record_is_checked():
    raw = warc.record(1, "http://a/", b"xy", warc.digest(b"xy"))
    assert warc.parse(raw)["payload"] == b"xy"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"xy", b"xz"))
    assert warc.url_key("http://WWW.a.org:80/x?y#z") == "org,a,www)/x?y"


# --- 4


def brute_sets(rows):
    sets = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            groups[find(i)] = min(d, groups.get(find(i), d))
    return Counter((d, len(s), (groups.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets))


def near_copies(seed, groups, size, length):
    rng = random.Random(seed)
    out, k = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(*length))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            cut = rng.randint(0, max(1, len(copy) // 8))
            out.append((k, " ".join(copy[: len(copy) - cut]).title() if rng.random() < 0.3 else " ".join(copy[cut:]), "s"))
            k += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,length", [(1, (5, 14)), (2, (30, 90)), (3, (6, 60))])
def test_jaccard_components(spark, seed, length):
    rows = near_copies(seed, 12, 12, length)
    rows += [(900, None, "s"), (901, "", "s"), (902, "one two", "s"), (903, "One  TWO", "s"), (904, "a b c d e", "s"), (None, rows[0][1], "s"), (905, "A b c\nd e", "s"), (905, rows[5][1], "s"), (906, "w " * 40, "s")]
    got = Counter(map(tuple, jaccard_join.near_duplicates(documents(spark, rows)).collect()))
    assert got == brute_sets(rows)


def test_jaccard_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLE", 50)
    monkeypatch.setattr(jaccard_join, "HOT", 0.05)
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(9)
    rows = [(k, " ".join(f"u{rng.randrange(40)}" for _ in range(rng.randint(0, 25))) + " " + passage + " " + t.split(" ", 3)[-1], s) for k, t, s in near_copies(7, 15, 10, (20, 60))]
    assert Counter(map(tuple, jaccard_join.near_duplicates(documents(spark, rows)).collect())) == brute_sets(rows)


def test_jaccard_small_buckets_and_long_lists(spark, monkeypatch):
    """Tokens dealt in two shuffles, lists over salts, and set keys that different sets share."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 64)
    monkeypatch.setattr(jaccard_join, "BLOCKS", 8)
    monkeypatch.setattr(jaccard_join, "GROUP", 200)
    monkeypatch.setattr(jaccard_join, "LIST", 3)
    rows = near_copies(11, 8, 9, (10, 40))
    sets, clash = jaccard_join.document_sets(documents(spark, rows), common.Scratch(spark, "t"))
    assert not clash
    some = frozenset(r["set_id"] for r in sets.collect()[::2])
    assert all(jaccard_join.set_key(s, some) not in some for s in map(jaccard_join.shingle_set, [t for _, t, _ in rows]) if jaccard_join.set_key(s) in some)
    assert Counter(map(tuple, jaccard_join.near_duplicates(documents(spark, rows)).collect())) == brute_sets(rows)


def test_set_keys_that_meet_are_replaced(spark, monkeypatch):
    real = jaccard_join._set_rows
    weak = lambda docs, words, clash: real(docs, words, clash) if clash else real(docs, words, clash).withColumn("set_id", F.when(F.col("set_id").isNotNull(), F.lit(5)))
    monkeypatch.setattr(jaccard_join, "_set_rows", weak)
    _, clash = jaccard_join.document_sets(documents(spark, near_copies(12, 3, 3, (10, 20))), common.Scratch(spark, "t"))
    assert clash == {5}


def test_words_of_any_length_have_one_hash(monkeypatch):
    long = "x" * (1 << 20)
    for text in (long, long + " ", " " + long, long + "y", "a " + long + " b", "\u00e9" * 600_000 + " end"):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        got = jaccard_join._word_hashes(text.encode())
        assert got.tolist() == [int(jaccard_join._word_hash(w.encode())[0]) for w in words] == [int(jaccard_join._word_hashes(w.encode())[0]) for w in words]


def test_one_of_each_keeps_columns(spark):
    rows = near_copies(4, 5, 6, (30, 50)) + [(None, "a b c d e f", "s")]
    docs = documents(spark, rows).withColumn("set_id", F.lit("mine"))
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    want = {c for (d, _, c) in brute_sets(rows) if d is not None}
    assert {r["doc_id"] for r in out.collect()} == want | {None}


# --- 5


def test_mix(spark, mixed):
    rows = [(d, t, s) for d, t, s in mixed]
    docs = documents(spark, rows).withColumn("size", F.lit(-1))
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, target, stopped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: 2.0 * sizes[s] if s in stopped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            break
        stopped |= above
    assert len(got) == len(rows)
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    largest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in names)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(3)).collect()))


@pytest.mark.parametrize("few", [10**6, 1])
def test_mix_repeated_and_null_ids(spark, monkeypatch, few):
    """Half of the ids null, one id in two sources, one row repeated in a third of all rows: every source within one row of its target."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", few)
    rows = [(None if k % 2 else k, f"ten words of text number {k} are these in here", "a") for k in range(200)]
    rows += [(None, "always the same row of ten words in source b", "b")] * 150 + [(1000 + k, f"w {k}", "b") for k in range(20)]
    rows += [(7, "one id in two sources", "c"), (7, "one id in two sources", "d"), (7, None, "c")] + [(2000 + k, "five words of source d", "d") for k in range(9)]
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source_size"]] += r["size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert len(got) == len(rows) and all(z == n for z, n in sizes.items()) and len(target) == 4
    assert all(abs(taken[z] - target[z]) <= 5 for z in target), (taken, target)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))
    # the same copies on the rows themselves, whatever their order
    mine = docs.withColumn("copies", F.lit("mine"))
    rowed = [mixing.with_copies(x, "_n", "_z").collect() for x in (mine, mine.repartition(7))]
    assert len({str(sorted(map(repr, r))) for r in rowed}) == 1 and all(r["copies"] == "mine" for r in rowed[0])
    assert Counter((r["doc_id"], r["_z"], r["_n"]) for r in rowed[0]) == Counter((r["doc_id"], r["size"], r["copies"]) for r in got)


def test_mix_empty(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0


# --- 6


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://x.example.com/de/?q=/en/": ("x.example.com", "/de/", "example.com/de/", "block"),
        "http://example.com/en/": ("example.com", "/en/", None, "allow"),
        "ftp://w.org/fr/a#b": ("w.org", "/fr/a", "org/fr/", "allow"),
        "http://notorg/fr/": ("notorg", "/fr/", None, "allow"),
        "http://net": ("net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "://h?x": ("h", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string").withColumn("key", F.lit(0))
    none = spark.createDataFrame([], "key string, tokens array<string>, confidence double, support double")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, none).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_mined_rules(spark):
    rng = random.Random(5)
    pages, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        host = "casino.example.com" if bad else rng.choice(["a.example.com", "b.example.com"])
        pages.append((k, f"http://{host}/{rng.choice(['en', 'es'])}/{k}?ref={k}"))
        if k % 2 == 0:
            labels.append((k, 0 if bad and k % 40 else 1, 0))
    pages += [(1000, "http://new.casino.example.com/x"), (1001, None), (1000, "http://new.casino.example.com/x")]
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels + [(None, 0, None), (5, None, None)], "doc_id long, quality int, toxic int")
    mined = url_filter.mine_rules(p, lab)
    rules = {tuple(r["tokens"]): r["confidence"] for r in mined.collect()}
    assert ("h:casino",) in rules and all(c >= url_filter.MIN_CONFIDENCE for c in rules.values())
    assert not any(set(a) < set(b) for a in rules for b in rules)
    got = url_filter.judge(p, mined).collect()
    assert len(got) == len(pages)
    assert all((r["verdict"] == "block") == ("casino" in r["host"]) for r in got)


# --- 8


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site {k}</header>
<nav><ul><li><a href="/a">Menu {k}</a></ul></nav><!-- <article>x</article> --><div class="ad">Buy {k}</div><article><h1>Head {k}</h1>
<p>First <b>bold</b>&amp; para   {k}.<br>next<p>Second &eacute; {k}</p><ul><li>one<li>two {k}</ul><div class="cookie-notice">Cookies {k}</div>
<form><p>mail {k}</p></form><section id="comments"><p>reader {k}</p></section></article><aside>side {k}</aside><footer>&copy; {k}</footer></body></html>"""


def test_main_text(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE.replace("{k}", str(k))) for k in range(30)]
    plain = "<html><body><div id=menu><a>m</a></div><div class=story><p>Only this text is long enough to be the story of page {k}.</p><p>And more of it, {k}.</p></div></body></html>"
    rows += [(100 + k, "http://plain.org/", plain.replace("{k}", str(k))) for k in range(5)]
    rows += [(200, None, None), (201, "http://h0.org/", ""), (202, "http://h0.org/", "<p>alone &am"), (202, "http://h0.org/", "<p>alone &am"), (203, None, "<article>x" + " y" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main", F.lit("no")).withColumn("host", F.lit("no"))
    found = html_wrappers.wrappers(pages)
    shown = {r["host"]: r["wrapper"] for r in found.collect()}
    assert "(<li>#TEXT</li>)+" in shown["h1.org"] or ")+" in shown["h1.org"]
    got = html_wrappers.extract_pages(pages, found).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[4] == "Head 4\nFirst bold& para 4. next\nSecond é 4\none\ntwo 4"
    assert by[103] == "Only this text is long enough to be the story of page 3.\nAnd more of it, 3."
    assert by[200] == by[201] == "" and by[202] == "alone &am" and by[203] == "x" + " y" * 40_000


def test_alignment_of_streams():
    level = html_wrappers.Level.of([("p", 1), ("p", 2), ("p", 3)])
    level.add(html_wrappers.Level.of([("p", 1), ("h2", 5), ("p", 4)]))
    assert level.pattern() == "((p)*(h2)?)*" and level.left == [("p", 1)] and level.right == [("p", None)]
    level = html_wrappers.Level.of([("h1", 1), ("div", None), ("p", 3)])
    level.add(html_wrappers.Level.of([("h1", 2), ("p", 3), ("p", 4)]))
    assert level.pattern() == "(h1)(div)?(p)+"


# --- 9


def test_exact_dedup(spark, mixed):
    docs = documents(spark, mixed).withColumn("_run", F.lit("x"))
    got = Counter(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t, _ in mixed:
        groups.setdefault(norm(t), []).append(d)
    want = Counter()
    for d, t, _ in mixed:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want[d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert got == want


def test_rounds_gather_every_digest_at_one_place(spark):
    """Round by round: what two places hold after it agrees in the digits done, equal digests merge, ids and counts are kept."""
    rows = [(k, f"text {k % 700}" if k % 3 else "the hot text", "s") for k in range(3000)]
    digests = exact_dedup.digest_rows(documents(spark, rows).repartition(40), 256)
    runs = digests.groupBy("_run", *exact_dedup.SAME).agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    want = {}
    for d, t, _ in rows:
        h = hashlib.sha256(t.encode()).hexdigest()
        want[h] = (min(d, want.get(h, (d,))[0]), want.get(h, (0, 0))[1] + 1)
    held = [len(runs.collect())]
    for k in range(2):
        runs = exact_dedup.merge_round(runs, k, 256)
        got = runs.collect()
        held.append(len(got))
        assert len({(r["_run"], r["text_sha256"]) for r in got}) == len(got)
        assert all(r["_run"] // 16**j % 16 == int(r["text_sha256"][j], 16) for r in got for j in range(k + 1))
    assert held[0] > held[1] > held[2] == len(want)
    assert {r["text_sha256"]: (r["_id"], r["_n"]) for r in got} == want


# --- 10


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice("the quick brown fox jumps over lazy dogs and rests by rivers".split()) for _ in range(60)).capitalize() + "."
    bad = lambda: rng.choice([lambda: " ".join(["BUY!!"] * 50), lambda: " ".join(x + "%%%" for x in good().split()), lambda: good().upper() + "!!"])()
    rows = [(k, good() if k % 5 else bad(), "s") for k in range(600)] + [(9000, None, "s"), (9001, "", "s"), (9000, None, "s")]
    labels = [(k, int(k % 5 > 0), 0) for k in range(600)] + [(3, 0, 0), (None, 1, 0), (8, None, 0)]
    docs = documents(spark, rows).withColumn("score", F.lit("?"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ranker = quality_bt.train(docs, lab)
    got = quality_bt.classify(docs, ranker).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 > 0) for r in held]) > 0.95
    kept = quality_bt.keep_good(docs, ranker)
    assert kept.schema == docs.schema
    # the same weights whatever the order of rows, and 0.5 without labels
    again = quality_bt.train(docs.repartition(7), lab)
    assert np.allclose(ranker.w, again.w)
    empty = quality_bt.train(docs, lab.where("false"))
    assert {r["score"] for r in quality_bt.classify(docs, empty).collect()} == {0.5}


def test_quality_learns_words(spark):
    """Texts of equal statistics that differ in their words only; a very long text, ties at the cut and repeated ids."""
    rng = random.Random(6)
    pools = [["rabak", "sofet", "lumin", "dorap", "kenit", "tisol"], ["rabek", "sofit", "lumon", "dorup", "kenat", "tisel"]]
    text = lambda y: " ".join(rng.choice(pools[y] if rng.random() < 0.5 else ["common", "filler", "words", "between"]) for _ in range(40))
    rows = [(k, text(k % 2), "s") for k in range(500)] + [(k, text(k % 2), "s") for k in range(0, 500, 7)] + [(9000, " ".join(text(1) for _ in range(3000)), "s")]
    docs, lab = documents(spark, rows), spark.createDataFrame([(k, k % 2, 0) for k in range(500)], "doc_id long, quality int, toxic int")
    ranker = quality_bt.train(docs, lab)
    got = quality_bt.classify(docs, ranker).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert np.mean([(r["score"] > 0.3) == bool(r["doc_id"] % 2) for r in held]) > 0.9
    assert [r["predicted"] for r in got if r["doc_id"] == 9000] == [1]
    assert {r["predicted"] for r in got} == {0, 1} and all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_grams_and_odds():
    a, b = quality_bt.grams("one two  ONE two"), quality_bt.grams("one two one two")
    assert [len(x) for x in a[:2]] == [2, 2] and all((x == y).all() for x, y in zip(a[:2], b[:2], strict=True))
    assert [len(x) for x in quality_bt.grams("")] == [len(x) for x in quality_bt.grams(None)] == [0, 0, 0]
    counts = np.zeros((2, quality_bt.KINDS, quality_bt.BUCKETS))
    counts[:, 0, 5] = 8, 2
    counts[:, 0, 6] = 0, 8
    odds = quality_bt.log_odds(counts)
    assert odds[0, 5] == pytest.approx(np.log((3 / 10) / (9 / 10))) and odds[0, 6] > 0 and odds[1, 7] == 0


def test_empty_tables(spark):
    docs = documents(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert line_dedup.line_digest(docs).count() == 0
    assert embedding_dups.near_duplicates(vec).count() == 0
    assert warc.archive_round_trip(pages).count() == 0
    assert jaccard_join.near_duplicates(docs).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert html_wrappers.extract_pages(pages, html_wrappers.wrappers(pages)).count() == 0
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filter.judge(pages, url_filter.mine_rules(pages, lab)).count() == 0
    assert quality_bt.classify(docs, quality_bt.train(docs, lab)).count() == 0


def test_scratch_is_removed_and_never_local_on_a_cluster(spark, mixed, tmp_path):
    import os

    root = spark.conf.get("spark.checkpoint.dir")[len("file://") :]
    before = set(os.listdir(root))
    with common.scratch_scope():
        assert exact_dedup.exact_dedup(documents(spark, mixed)).count() == len(mixed)
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Cluster())
    Cluster.sparkContext.master = "local[2]"
    assert common.shared_dir(Cluster()).startswith("file://")


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "c"), one_task=one_task).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
