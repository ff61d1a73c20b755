"""Main text: containers keep what they hold, wrappers of all pages decide, and levels against brute force."""

import random
import re
import time

from strandframe.llm import html_wrappers as W


def test_container_keeps_all_blocks():
    assert W.extract("<div class=content><p>first words</p><ul><li>" + "long item " * 9 + "</li></ul></div>", None) == "first words\n" + ("long item " * 9).strip()
    for inner in ("<table><tr><td>{}</td></tr></table>", "<blockquote><p>{}</p></blockquote>", "<section class=x><p>{}</p></section>"):
        for outer in ("<div class=content>", "<div>"):
            got = W.extract(f"<body>{outer}<p>first</p>{inner.format('much more text ' * 9)}</div></body>", None)
            assert got.startswith("first\nmuch more text"), (inner, outer)
    assert W.extract("<div class=content><p>first</p><div class=entry><p>" + "much more text " * 9 + "</p></div></div>", None).startswith("first\nmuch")
    assert W.extract("<body><ul><li>only</li><li>items</li></ul></body>", None) == "only\nitems"
    assert W.extract("<body><p>site line</p><div id=content><p>the text</p></div></body>", None) == "the text"


def test_modifiers_do_not_drop_the_container():
    assert W.extract("<article class='post comments-open'><p>kept</p></article>", None) == "kept"
    assert W.extract("<div id=content class=with-sidebar><p>kept</p><div class=sidebar>no</div></div>", None) == "kept"
    assert W.extract("<main class=search-page><p>kept</p></main>", None) == "kept"
    assert W.extract("<div class=content><p>kept</p><div class='related-content'>no</div><div class='comment post'>no</div></div>", None) == "kept"


def test_marks_do_not_count_on_or_above_the_container():
    assert W.extract("<div class='page has-sidebar'><article>kept</article></div><div>foot</div>") == "kept"
    assert W.extract("<div class='tags-list article-body'><p>kept</p></div><div class='tags-list'>no</div>") == "kept"
    assert W.extract("<body><form action=x><nav>m</nav><p>all in</p><p>a form</p></form><footer>f</footer></body>") == "all in\na form"
    assert W.extract("<div class=sidebar><article><p>kept</p></article></div>") == "kept"
    assert W.extract("<body><nav>only</nav><footer>these</footer></body>") == ""
    assert W.extract("<p title=it's>stray</p><p>quote</p>") == "stray\nquote"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, rows):
    pages = pages_of(spark, rows)
    return {r["page_id"]: r["text"] for r in W.extract_pages(pages, W.rules(W.levels(pages))).collect()}


def test_every_template_of_a_host_counts(spark):
    """A template in 2 percent of the pages of a host, whose frame is shared and whose neutral side box never changes."""
    common = "<body><div class=frame><div class=x1><p>Common text {k}, quite long.</p></div><div class=x2><p>More {k}.</p></div></div></body>"
    rare = "<body><div class=frame><div class=y1><p>Always the same box.</p></div><div class=y2><p>Rare text {k}.</p><p>End {k}.</p></div></div></body>"
    rows = [(k, f"http://big.org/{k}", (common if k % 50 else rare).replace("{k}", str(k))) for k in range(400)]
    assert texts(spark, rows) == {k: f"Common text {k}, quite long.\nMore {k}." if k % 50 else f"Rare text {k}.\nEnd {k}." for k in range(400)}
    found = {r["host"]: r for r in W.wrappers(pages_of(spark, rows)).collect()}
    assert found["big.org"]["pages"] == 400
    assert "(<div.y1>(<p>(#FIXED)</p>)</div.y1>)?" in found["big.org"]["wrapper"] and "(<div.y2>(<p>(#TEXT)</p>)+</div.y2>)?" in found["big.org"]["wrapper"]


def test_the_wrapper_decides(spark):
    """Fixed lines at either end of an article, a larger container on other pages, and repeated inner articles; each differs from the page alone."""
    page = "<main><article class=teaser><p>{t}</p></article><article class=story><h1>Head {k}</h1>{ps}<p>Share this story</p><article>reader {k}</article>{more}</article></main>"
    rows = []
    for k in range(40):
        ps = "".join(f"<p>words {k} {j}</p>" for j in range(k % 4 + 1))
        teaser = "a teaser longer than the story of its page " * 9 if k == 7 else "t"
        rows.append((k, "http://a.org/x", page.format(k=k, ps=ps, t=teaser, more="<article>again</article>" if k % 2 else "")))
    rows += [(100 + k, "http://few.org/", f"<article><p>text {k}</p><p>Share this story</p></article>") for k in range(4)]
    rows += [(200 + k, "http://same.org/", "<article><p>one text</p><p>many rows</p></article>") for k in range(20)]
    rows += [(300 + k, "http://list.org/", f"<article><ul><li>fixed item<li>item {k}</ul></article>") for k in range(20)]
    got = texts(spark, rows)
    for k in range(40):
        # the last paragraph has no fixed place from the right, as one or two inner articles follow; it is one of the repeated paragraphs
        assert got[k] == "\n".join([f"Head {k}"] + [f"words {k} {j}" for j in range(k % 4 + 1)] + ["Share this story"])
    assert "teaser" in W.extract(rows[7][2]) and "reader" in W.extract(rows[0][2])
    assert all(got[100 + k] == f"text {k}\nShare this story" for k in range(4))
    assert all(got[200 + k] == "one text\nmany rows" for k in range(20))
    assert all(got[300 + k] == f"fixed item\nitem {k}" for k in range(20))
    rows = [(k, "http://a.org/x", f"<article><p>Posted by us</p><h1>Head {k}</h1>" + "<p>w</p>" * (k % 3) + f"<p>the words of page {k}</p><div class=c9000{k}>Follow us</div><p>Share this</p></article>") for k in range(20)]
    got = texts(spark, rows)
    assert all(got[k] == "\n".join([f"Head {k}"] + ["w"] * (k % 3) + [f"the words of page {k}"]) for k in range(20))


def test_named_elements_that_repeat(spark):
    rows = [(k, "http://b.org/", f"<body><div class=post>teaser {k}</div><div class=post>teaser</div><div class=entry-content><p>Body {k}</p></div></body>") for k in range(3)]
    assert texts(spark, rows) == {k: f"Body {k}" for k in range(3)}


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_align_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.sample("abcdefghij", rng.randint(0, 10)) for _ in range(2))
        got = W.align(a, b)
        assert len(got) == len(a) + len(b) - lcs(a, b)
        for x in (a, b):
            it = iter(got)
            assert all(c in it for c in x)


def test_levels_accept_all_pages():
    rng = random.Random(2)
    for _ in range(300):
        seqs = [[rng.choice("abcde") for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 6))]
        toks = [[(c, rng.randint(0, 1)) for c in s] for s in seqs]
        level = W.Level.of(toks[0])
        for t in toks[1:]:
            level.add(W.Level.of(t))
        assert all(re.fullmatch(level.pattern(), "".join(s)) for s in seqs), (seqs, level.pattern())
        names = [c for g in level.groups for c in g]
        assert len(names) == len(set(names))
        shortest = min(map(len, seqs))
        want = []
        for i in range(shortest):  # fixed places, by comparing all pages at once
            if len({t[i][0] for t in toks}) > 1:
                break
            want.append((toks[0][i][0], toks[0][i][1] if len({t[i][1] for t in toks}) == 1 else None))
        assert level.left == want
        again = W.Level.load(level.dump())
        assert (again.left, again.right, again.counts, again.groups) == (level.left, level.right, level.counts, level.groups)


def test_long_and_deep_pages(spark):
    rng = random.Random(3)
    parts = ["<p>a %d</p>", "<h2>b %d</h2>", "<ul><li>c %d<li>d</ul>", "<div class=q>e %d</div>"]
    long = ["<article>" + "".join(rng.choice(parts) % i for i in range(16_000)) + "</article>" for _ in range(2)]
    deep = "<div>" * 8000 + "x" + "</div>" * 8000
    start = time.time()
    got = texts(spark, [(k, "http://a.org/", h) for k, h in enumerate([*long, deep, deep])])
    assert time.time() - start < 60
    assert got[0].count("\n") >= 16_000 and got[2] == got[3] == "x"


def test_rules_do_not_depend_on_the_partitions(spark):
    """Decisions of a host against one pass over all of its pages, whatever tasks they lie in."""
    rng = random.Random(7)
    rows = []
    for k in range(120):
        parts = ["<p>Posted by us</p>"] * (k % 10 > 0) + [f"<h1>Head {k}</h1>"] + [f"<p>text {k} {j} of the page</p>" for j in range(rng.randint(1, 4))] + ["<div class=x1>Follow us</div>"] * rng.randint(0, 1) + ["<p>Share this</p>"]
        rows.append((k, f"http://h{k % 3}.org/", f"<body><div class=menu>m {k}</div><article>{''.join(parts)}</article></body>"))
    pages = pages_of(spark, rows)
    show = lambda df: sorted(map(repr, W.rules(W.levels(df)).collect()))
    assert show(pages.repartition(1)) == show(pages.repartition(13))
    for r in W.rules(W.levels(pages)).collect():
        own = [h for k, u, h in rows if u == f"http://{r['host']}/"]
        article = [e for h in own for e in W.parse(h)[1] if e.name == "article"]
        assert {e.id for e in article} == {r["main"]}
        at = [p["at"] for p in r["literals"] if p["path"] == r["main"]]
        tokens = [e.tokens() for e in article]
        want = []
        for side in (1, -1):
            for i in range(min(map(len, tokens))):
                here = {t[::side][i] for t in tokens}
                if len({s for s, _ in here}) > 1:
                    break
                if len(here) == 1 and next(iter(here))[1] is not None:
                    want.append(i if side == 1 else -1 - i)
        assert sorted(at) == sorted(want)
