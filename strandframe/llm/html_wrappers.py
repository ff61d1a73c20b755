"""Main-text extraction with wrappers inferred as union-free regular expressions.

A page is a stream of tags and texts; inline tags belong to the text. The wrapper of a host accepts the streams of all its
pages. As tags nest, it is kept as one *level* for each path of tags: the expression of what stands inside that
element. A level holds

* ``groups``: its children in order, each signature once. Children seen on some pages only are optional, several in a row
  repeated; children that repeat in turns or change places form one repeated group of optional members;
* ``left`` and ``right``: the children at fixed places counted from either end, with their text where it is the same on
  every page (a literal) and none where it differs (a slot).

Two levels are merged by aligning their children. Each signature stands once in a level, so the longest common
subsequence is a longest increasing run of places: n log n time and linear memory however long a page is. Levels of all
pages (none is sampled) are merged within each task, then by host and path over all tasks.

The wrapper decides what is text:

* the container: of all article elements (else main elements) of the host, the path whose slots hold most text. Without
  any, the elements named as content by class or id, those that stand once before repeated ones; else the whole page;
* literals of the container at places of page layout (not inside lists, tables or quotes) are template, not text, once
  ``SUPPORT`` pages of different text agree on them. Pages that are two thirds literal are copies, and lose nothing;
* article elements that repeat inside the container are reader comments.

Menus, headers, footers, forms and the like are known by fixed tags, roles and class words; such a mark counts only
inside the container, never on it or above it. A form that holds all text there is, and a marked element that holds the
only headline, lose their mark. Pages without the container of their host use their own best one.

Nulls and edges: null or empty html has empty text; a null url has host ''; rows that repeat a page_id are
extracted each and count once as support. Empty table: empty result.
Extra columns are ignored. A host's decisions grow with the places of its templates, not with its pages.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, attach_by_key
from .url_filter import url_parts

#: Pages of different text that must agree on a text before it counts as a literal of the template.
SUPPORT = 8
#: Levels held by a task before they are handed on.
HELD = 50_000

#: Fixed HTML sets: elements without content, elements of raw text, elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements, roles and words in class or id that never belong to the article.
SKIP_TAGS = frozenset(
    "script style noscript nav header footer aside form menu menuitem dialog button select option input textarea iframe object embed svg canvas video audio template head title fieldset dialog map".split()
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIP_WORDS = frozenset(
    """ad ads adv advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside widget footer masthead topbar cookie cookies consent gdpr notice notification popup modal
    overlay subscribe newsletter signup login register comment comments reply replies respond disqus discussion social share sharing
    related recommended recommendations pagination pager skip search tags toolbar copyright legal disclaimer alert""".split()
)
#: Parts of a class word that say it only tells of something elsewhere or of a state.
NEUTRAL_FIRST = frozenset("has with without no not is".split())
NEUTRAL_LAST = frozenset("open closed enabled disabled on off active".split())
MAIN_TAGS = ("article", "main")
#: Elements of page layout; others (lists, tables, quotes) are content.
LAYOUT = frozenset("html body div section center form article main".split())
MAIN_WORDS = frozenset("article articlebody content post entry story main maincontent".split())
#: Words that may stand beside those in a compound.
MAIN_PARTS = MAIN_WORDS | frozenset("body text page".split())
#: Marks that an element may lose when it holds all the text there is.
WEAK_TAGS = frozenset(["form", *LAYOUT])
#: End tags that HTML lets one leave out: an opening tag closes these open elements.
_BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TAG = re.compile(r"""<(?:(!--)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*)>|([!?])[^>]*>)""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WS = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_TELLING = re.compile(r"class|id|style|hidden|role", re.I)
_DIGITS = re.compile(r"[0-9]{3,}")


def events(html: str):
    """Yield ('open', name, text of attributes) / ('close', name) / ('text', decoded text); comments and raw elements are left out."""
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            yield ("text", _html.unescape(html[at:]))
            return
        if m.start() > at:
            yield ("text", _html.unescape(html[at : m.start()]))
        at = m.end()
        if m[1]:
            end = html.find("-->", m.start() + 4)
            at = n if end < 0 else end + 3
        elif m[3]:
            name = m[3].lower()
            if m[2]:
                yield ("close", name)
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(html, at)
                at = n if end is None else end.end()
            else:
                yield ("open", name, m[4])
                if name in VOID:
                    yield ("close", name)


def _words(attrs: dict) -> list[list[str]]:
    """Words of class and id, each as its parts."""
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return [x for t in named.split() if (x := _WORD.findall(t))] if named != " " else []


def is_named(words: list[list[str]]) -> bool:
    """Whether a word of class or id says that the element is the content."""
    return any(set(w) <= MAIN_PARTS and not MAIN_WORDS.isdisjoint(w) for w in words)


def skips(name: str, attrs: dict) -> bool:
    """Whether an element is marked as boilerplate by its tag, role, visibility or the words of class and id."""
    if name in SKIP_TAGS or attrs.get("role", "").lower() in SKIP_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I):
        return True
    words = _words(attrs)
    if not words or name in ("body", "html", *MAIN_TAGS) or attrs.get("role") == "main":
        return False
    words = [w for w in words if not (len(w) > 1 and (w[0] in NEUTRAL_FIRST or w[-1] in NEUTRAL_LAST))]
    if is_named(words):  # a compound beside the name does not count, only a word of its own
        return any(len(w) == 1 and w[0] in SKIP_WORDS for w in words)
    return any(not SKIP_WORDS.isdisjoint(w) for w in words)


def signature(name: str, attrs: dict) -> str:
    """Name and classes (numbers of three digits or more as 0), by which the same element of other pages is known."""
    classes = ".".join(sorted({*_DIGITS.sub("0", attrs.get("class", "").lower()).split(), *(MAIN_WORDS & {attrs.get("id", "").lower()})}))
    return name + ("." + classes if classes else "") + ("#main" if attrs.get("role") == "main" else "")


@lru_cache(maxsize=1 << 14)
def described(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(signature, marked as boilerplate, named as the content, a main element) of an opening tag."""
    attrs = {a[0].lower(): _html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(attributes)} if attributes.strip(" /") else {}
    return signature(name, attrs), skips(name, attrs), is_named(_words(attrs)), name == "main" or attrs.get("role") == "main"


def _long(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed % (1 << 64)) - (1 << 63)


class Element:
    """An open or closed block element: its path (``id``), marks and containers above it, and its children."""

    __slots__ = ("article", "at", "depth", "flat", "id", "inline", "inner", "kids", "main", "mark", "marked", "marker", "name", "named", "sig", "up")

    def __init__(self, up: Element | None, name: str, sig: str, marked: bool, named: bool, main: bool):
        self.up, self.name, self.sig, self.marked, self.inline = up, name, sig, marked, False
        self.id = _long(sig, up.id if up else 0)
        self.depth = up.depth + 1 if up else 0
        self.flat = name in LAYOUT and (up is None or up.flat)
        self.kids: list = []
        # outermost article, article inside that, main, named element; nearest marked one
        self.article = up.article if up and up.article else self if name == "article" else None
        self.inner = up.inner if up and up.inner else self if name == "article" and self.article is not self else None
        self.main = up.main if up and up.main else self if main else None
        self.marker = self if marked else up.marker if up else None
        self.named = up.named if up and up.named else self if named and self.marker is None else None
        self.at = len(up.kids) if up else 0

    def tokens(self) -> list[tuple[str, int | None]]:
        """(signature, text hash or None) of the children; an element counts by its text if it holds nothing but one text."""
        return [k if isinstance(k, tuple) else (k.sig, k.kids[0][1] if k.is_leaf() else None) for k in self.kids]

    def is_leaf(self) -> bool:
        return len(self.kids) == 1 and isinstance(self.kids[0], tuple)

    def container(self) -> Element | None:
        return self.article or self.main

    def rank(self) -> int:
        """Of a container: article before main, unmarked surroundings before both."""
        return (2 if self.name == "article" else 1) + (2 if self.up is None or self.up.marker is None else 0)


def parse(html: str | None) -> tuple[list[tuple[Element, int, str]], list[Element]]:
    """((element, place among its children, text) of every block of text, all block elements)."""
    root = Element(None, "", "", False, False, False)
    root.flat = True
    stack: list = [root]  # block elements; inline ones as (name, marked)
    block, open_names = [root], Counter()
    elements, out, parts = [root], [], []

    def flush():
        if not parts:
            return
        text = _WS.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            e = block[-1]
            out.append((e, len(e.kids), text))
            e.kids.append(("#text", _long(text)))

    def pop_to(k: int):
        if any(isinstance(e, Element) for e in stack[k:]):
            flush()
        for e in stack[k:]:
            if isinstance(e, Element):
                block.pop()
                open_names[e.name] -= 1
            else:
                open_names[e[0]] -= 1
        del stack[k:]

    name_of = lambda e: e.name if isinstance(e, Element) else e[0]

    def nearest(names) -> int:
        """Place in the stack of the nearest open element of ``names``, or -1."""
        return next((i for i in range(len(stack) - 1, 0, -1) if name_of(stack[i]) in names), -1)

    for e in events(html or ""):
        if e[0] == "text":
            top = stack[-1]
            if not isinstance(top, Element) and top[1] and e[1].strip():
                continue  # an inline element that is boilerplate
            parts.append(e[1])
        elif e[0] == "open":
            name = e[1]
            if name == "br":
                parts.append(" ")
                continue
            if name in INLINE:
                if name not in VOID:
                    top = stack[-1]
                    # a link's target tells nothing; only these attributes can mark it
                    marked = not isinstance(top, Element) and top[1]
                    stack.append((name, marked or (_TELLING.search(e[2]) is not None and described(name, e[2])[1]) or name in SKIP_TAGS))
                    open_names[name] += 1
                continue
            flush()
            if name in _BLOCKS:
                if open_names["p"]:
                    k = nearest(("p", "button", "td", "article", "div"))
                    if k >= 0 and name_of(stack[k]) == "p":
                        pop_to(k)
            elif name in _CLOSES and any(open_names[x] for x in _CLOSES[name]):
                k = nearest((*_CLOSES[name], "ul", "ol", "table", "dl", "select", "tr" if name in ("td", "th") else "table"))
                if k >= 0 and name_of(stack[k]) in _CLOSES[name]:
                    pop_to(k)
            if name not in VOID:
                own = Element(block[-1], name, *described(name, e[2]))
                block[-1].kids.append(own)
                elements.append(own)
                block.append(own)
                stack.append(own)
                open_names[name] += 1
        elif e[1] not in VOID and open_names[e[1]]:
            pop_to(nearest((e[1],)))
    flush()
    return out, elements


# --- levels: the expression of the children of one path


def collapse(seq: list[str], together=()) -> list[list[str]]:
    """Groups of a sequence in which every item shall stand once: what lies between two places of one item, and the
    members of each group of ``together``, become one group."""
    first, last = {}, {}
    for i, s in enumerate(seq):
        first.setdefault(s, i)
        last[s] = i
    spans = [(first[s], last[s]) for s in first] + [(min(first[s] for s in g), max(last[s] for s in g)) for g in together if len(g) > 1]
    out, end = [], -1
    for a, b in sorted(spans):
        if a > end:
            out.append([])
            end = a - 1
        if b > end:
            out[-1] += seq[end + 1 : b + 1]
            end = b
    return [list(dict.fromkeys(g)) for g in out]


def align(a: list[str], b: list[str]) -> list[str]:
    """One sequence that holds both; a longest common subsequence is shared. Items are distinct within each."""
    place = {s: j for j, s in enumerate(b)}
    ends, ends_at, before = [], [], {}
    for i, s in enumerate(a):
        if s in place:
            k = bisect_left(ends, place[s])
            before[i] = ends_at[k - 1] if k else -1
            ends[k : k + 1], ends_at[k : k + 1] = [place[s]], [i]
    shared, i = [], ends_at[-1] if ends_at else -1
    while i >= 0:
        shared.append(i)
        i = before[i]
    out, i, j = [], 0, 0
    for k in reversed(shared):
        out += a[i:k] + b[j : place[a[k]]] + [a[k]]
        i, j = k + 1, place[a[k]] + 1
    return out + a[i:] + b[j:]


def _agree(a: list, b: list) -> list:
    """Tokens at the same places while the signatures agree; texts that differ leave a slot."""
    out = []
    for x, y in zip(a, b, strict=False):
        if x[0] != y[0]:
            break
        out.append(x if x[1] == y[1] else (x[0], None))
    return out


class Level:
    """The expression of the children of one path, over all of its instances."""

    __slots__ = ("counts", "groups", "left", "right", "seen")

    def __init__(self, left, right, counts, groups):
        self.left, self.right, self.counts, self.groups, self.seen = left, right, counts, groups, set()

    @classmethod
    def of(cls, tokens) -> Level:
        if len(tokens) == 1:
            s = tokens[0][0]
            return cls(tokens, tokens, {s: (1, 1)}, [[s]])
        names = [s for s, _ in tokens]
        return cls(tokens, tokens[::-1], {s: (n, n) for s, n in Counter(names).items()}, collapse(names))

    def add(self, other: Level) -> None:
        if self.left != other.left:
            self.left = _agree(self.left, other.left)
        if self.right != other.right:
            self.right = _agree(self.right, other.right)
        if self.groups == other.groups and self.counts == other.counts:
            return
        key = tuple(map(tuple, other.groups))
        if key not in self.seen:  # an order of children that is new to this level
            if len(self.seen) < 1000:
                self.seen.add(key)
            if self.groups != other.groups:
                self.groups = collapse(align([s for g in self.groups for s in g], [s for g in other.groups for s in g]), [*self.groups, *other.groups])
        none = (0, 0)
        for s in {*self.counts, *other.counts}:
            (a, b), (c, d) = self.counts.get(s, none), other.counts.get(s, none)
            self.counts[s] = (min(a, c), max(b, d))

    def repeats(self, sig: str) -> bool:
        return self.counts[sig][1] > 1

    def pattern(self, show=re.escape) -> str:
        """The level as a regular expression over the signatures of its children, each shown by ``show``."""
        out = []
        for g in self.groups:
            if len(g) == 1:
                low, high = self.counts[g[0]]
                out.append(f"({show(g[0])})" + (("+" if high > 1 else "") if low else ("*" if high > 1 else "?")))
            else:
                out.append("(" + "".join(f"({show(s)})*" if self.counts[s][1] > 1 else f"({show(s)})?" for s in g) + ")*")
        return "".join(out)

    def dump(self) -> str:
        return json.dumps([self.left, self.right, self.counts, self.groups])

    @classmethod
    def load(cls, text: str) -> Level:
        left, right, counts, groups = json.loads(text)
        return cls([tuple(x) for x in left], [tuple(x) for x in right], {s: tuple(v) for s, v in counts.items()}, groups)


class _Path:
    """What all pages of a host hold at one path."""

    __slots__ = ("candidate", "chars", "flat", "instances", "level", "named", "pages", "rank", "sig", "support", "up")

    def add(self, other: _Path) -> None:
        self.chars, self.instances, self.pages = self.chars + other.chars, self.instances + other.instances, self.pages + other.pages
        self.support = sorted({*self.support, *other.support})[:SUPPORT]
        self.level.add(other.level)

    def row(self) -> tuple:
        return (self.up, self.sig, self.flat, self.named, self.candidate, self.rank, self.chars, self.instances, self.pages, self.support, self.level.dump())

    @classmethod
    def load(cls, row: dict) -> _Path:
        out = cls()
        for k in ("up", "sig", "flat", "named", "candidate", "rank", "chars", "instances", "pages", "support"):
            setattr(out, k, row[k])
        out.level = Level.load(row["level"])
        return out


def page_paths(html: str | None) -> dict[int, _Path]:
    """The levels of one page, by path."""
    texts, elements = parse(html)
    content = _long("\n".join(t for e, _, t in texts if e.marker is None))
    found: dict[int, _Path] = {}
    for e in elements:
        if not e.kids:
            continue
        x, c = _Path(), e.container()
        x.up, x.sig, x.flat, x.named = e.up.id if e.up else 0, e.sig, e.flat, e.named is e
        x.candidate, x.rank = (c.id, c.rank()) if c else (0, 0)
        x.chars, x.instances, x.pages, x.support, x.level = 0, 1, 1, [content], Level.of(e.tokens())
        if e.id in found:
            found[e.id].add(x)
            found[e.id].pages = 1
        else:
            found[e.id] = x
    for e, _, text in texts:
        c = e.container()
        if c is None or e.marker is None or e.marker.depth <= c.depth:
            found[e.id].chars += len(text)
    return found


_ROWS = "host string, path long, up long, sig string, flat boolean, named boolean, candidate long, rank int, chars long, instances long, pages long, support array<long>, level string"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]


def _path_batch(found: dict) -> pa.RecordBatch:
    columns = zip(*((*k, *v.row()) for k, v in found.items()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])


def _paths(batches):
    """Paths of the pages of a task, merged by host."""
    found: dict[tuple, _Path] = {}
    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for path, x in page_paths(html).items():
                if (host, path) in found:
                    found[host, path].add(x)
                else:
                    found[host, path] = x
            if len(found) > HELD:
                yield _path_batch(found)
                found.clear()
    if found:
        yield _path_batch(found)


def _merged(batches):
    """Rows sorted by host and path to one row a path; one level is held at a time."""
    key, held = None, None
    for b in batches:
        out: dict = {}
        for row in b.to_pylist():
            if (row["host"], row["path"]) == key:
                held.add(_Path.load(row))
            else:
                if held is not None:
                    out[key] = held
                key, held = (row["host"], row["path"]), _Path.load(row)
        if out:
            yield _path_batch(out)
    if held is not None:
        yield _path_batch({key: held})


def levels(pages: DataFrame) -> DataFrame:
    """The wrappers of all hosts as one row for each host and path, from all pages."""
    host, _ = url_parts(F.col("url"))
    each = pages.select(host.alias("host"), "html").mapInArrow(_paths, _ROWS)
    return each.repartition("host", "path").sortWithinPartitions("host", "path", "level").mapInArrow(_merged, _ROWS)


_FACTS = "host string, pages long, kind string, id long, at int, rank int, chars long"


def level_facts(path: int, x: _Path):
    """(kind, id, at, rank, chars) that a level of the wrapper says: 'cand' text of slots in a container, 'lit' a literal at a
    place (negative from the right), 'rep' an article or named child that repeats."""
    fixed = [t[1] is not None for t in x.level.left]
    if x.candidate and x.chars and not (fixed and all(fixed) and len(fixed) == sum(n for _, n in x.level.counts.values()) and len(x.support) >= SUPPORT):
        yield "cand", x.candidate, 0, x.rank, x.chars
    if len(x.support) >= SUPPORT:
        if x.flat:
            yield from (("lit", path, i, 0, 0) for i, t in enumerate(x.level.left) if t[1] is not None)
            yield from (("lit", path, -1 - i, 0, 0) for i, t in enumerate(x.level.right) if t[1] is not None)
        elif x.instances == x.pages and x.level.counts == {"#text": (1, 1)} and x.level.left[0][1] is not None:
            yield "leaf", path, 0, 0, 0
    for sig in x.level.counts:
        if sig.startswith("article") and x.level.repeats(sig):
            yield "rep", _long(sig, path), 0, 0, 0
    if x.named and x.instances > x.pages:
        yield "rep", path, 0, 0, 0


def _facts(batches):
    for b in batches:
        out = [(r["host"], r["pages"], *f) for r in b.to_pylist() for f in level_facts(r["path"], _Path.load(r))]
        out += [(r["host"], r["pages"], "page", 0, 0, 0, 0) for r in b.select(["host", "pages", "up", "sig"]).to_pylist() if r["sig"] == "" and r["up"] == 0]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FACTS.split(", ")])


def rules(wrapper: DataFrame) -> DataFrame:
    """(host, pages, main, literals, repeats): what the ``levels`` decide for each host."""
    f = wrapper.mapInArrow(_facts, _FACTS)
    per = f.groupBy("host", "kind", "id", "at").agg(F.max("rank").alias("rank"), F.sum("chars").alias("chars"), F.max("pages").alias("pages"))
    main = F.max_by("id", F.when(F.col("kind") == "cand", F.struct("rank", "chars", "id")))
    place = lambda kinds, x: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), x)))
    spot = F.struct(F.col("id").alias("path"), F.when(F.col("kind") == "lit", F.col("at")).alias("at"))
    return per.groupBy("host").agg(F.max("pages").alias("pages"), main.alias("main"), place(["lit", "leaf"], spot).alias("literals"), place(["rep"], F.col("id")).alias("repeats"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``rules`` with the expression of each host as text, to be read by people. One host's expression is one value."""
    found = Scratch(pages.sparkSession, "wrappers").store(levels(pages), "levels")

    def show(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [render({r.path: (Level.load(r.level), r.flat) for r in pdf.itertuples()})]})

    return rules(found).join(found.select("host", "path", "flat", "level").groupBy("host").applyInPandas(show, "host string, wrapper string"), "host", "left")


def render(by_path: dict[int, tuple[Level, bool]]) -> str:
    """A wrapper, by path, as one expression: #TEXT is a slot, #FIXED the same text on all pages."""
    parts, todo = [], [("", _long(""))]
    while todo:
        text, path = todo.pop()
        parts.append(text)
        if path not in by_path:
            continue
        level, names = by_path[path][0], []
        fixed = level.counts.get("#text") == (1, 1) and any(s == "#text" and h is not None for s, h in level.left)
        show = lambda s: names.append(s) or f"\x00{len(names) - 1}\x00"  # noqa: B023, E731
        found = []
        for piece in re.split("(\x00[0-9]+\x00)", level.pattern(show)):
            sig = names[int(piece.strip("\x00"))] if piece.startswith("\x00") else None
            if sig is None:
                found.append((piece, None))
            elif sig == "#text":
                found.append(("#FIXED" if fixed else "#TEXT", None))
            else:
                found += [(f"<{sig}>", _long(sig, path)), (f"</{sig}>", None)]
        todo += reversed(found)
    return "".join(parts)


# --- extraction


def main_blocks(texts, main: int | None = None, literals=(), repeats=()) -> list[str]:
    """The texts of a page that belong to the article, by what the wrapper of its host says."""
    repeats = set(repeats or ())
    own: dict[int, list] = {}
    for x in texts:
        c = x[0].container()
        if c is not None and (x[0].marker is None or x[0].marker.depth <= c.depth):
            own.setdefault(c.id, []).append(x)
    kept = []
    if own:
        best = main if main in own else max(own, key=lambda k: (own[k][0][0].container().rank(), sum(len(t) for _, _, t in own[k]), k))
        inner = Counter(id(i.up) for i in {id(e.inner): e.inner for e, _, _ in own[best] if e.inner}.values())
        kept = [x for x in own[best] if not ((i := x[0].inner) and i.depth > x[0].container().depth and (i.id in repeats or inner[id(i.up)] > 1))]
    if not kept:
        free = [x for x in texts if x[0].marker is None and x[0].container() is None] if own else [x for x in texts if x[0].marker is None]
        named = [x for x in free if x[0].named]
        once = Counter(i.id for i in {id(e.named): e.named for e, _, _ in named}.values())
        single = [x for x in named if x[0].named.id not in repeats and once[x[0].named.id] == 1]
        kept = single or named or free
    if not kept:
        kept = _unmarked(texts)
    lit = {(p["path"], p["at"]) for p in literals or ()}
    if lit:
        slots = [x for x in kept if not _literal(x[0], x[1], lit)]
        if sum(len(t) for _, _, t in slots) * 3 >= sum(len(t) for _, _, t in kept):
            kept = slots
    return [t for _, _, t in kept]


def _literal(e: Element, at: int, lit: set) -> bool:
    if (e.id, at) in lit or (e.id, at - len(e.kids)) in lit:
        return True
    up = e.up
    if up is None or not up.flat or not e.is_leaf():
        return False
    return (e.id, None) in lit or (up.id, e.at) in lit or (up.id, e.at - len(up.kids)) in lit


def _unmarked(texts) -> list:
    """Where all text is marked: what a form holds, or a marked element of layout with the only headline."""
    void: set[int] = set()
    while True:
        held: dict[int, list] = {}
        for e, at, t in texts:
            outer, m = None, e.marker
            while m is not None:
                if id(m) not in void:
                    outer = m
                m = m.up.marker if m.up else None
            held.setdefault(id(outer) if outer is not None else 0, []).append((outer, (e, at, t)))
        if 0 in held:
            return [x for _, x in held[0]]
        weak = [v for v in held.values() if v[0][0].name == "form" or (v[0][0].name in WEAK_TAGS and any(e.name == "h1" for _, (e, _, _) in v))]
        if not weak:
            return []
        void.add(id(max(weak, key=lambda v: sum(len(t) for _, (_, _, t) in v))[0][0]))


def extract(html: str | None, main: int | None = None, literals=(), repeats=()) -> str:
    """Main text of a page, by the rules of its host's wrapper, or on its own."""
    return "\n".join(main_blocks(parse(html)[0], main, literals, repeats))


def extract_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``, by the ``rules`` (or ``wrappers``) of all hosts."""
    host, _ = url_parts(F.col("url"))
    small = Scratch(pages.sparkSession, "templates").store(found.select(F.col("host").alias("_host"), "main", "literals", "repeats"), "rules")
    n = small.agg(F.sum(F.size("literals") + F.size("repeats") + 1)).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("_host"))
    joined = rows.join(F.broadcast(small), "_host", "left") if n <= BROADCAST_ROWS else attach_by_key(rows, small, "_host", ["page_id"])

    def run(batches):
        for b in batches:
            texts = [extract(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "main", "literals", "repeats").mapInArrow(run, "page_id long, url string, text string, n_chars long")
