"""URL filter: fixed host/path rules, then association rules mined by FP-growth from labels.

Labelled urls become baskets of tokens (host labels, path words, query keys), equal ones one basket with its weights.
The rules wanted are the *smallest* token combinations that reach the support and confidence bounds for the bad class (and, if
asked for, a bound on surprise); a combination that contains a smaller rule adds nothing. Three exact steps keep the mining small:

* tokens in fewer bad urls than the support bound, or in every labelled url, are left out;
* tokens that stand in exactly the same labelled urls are one item (the closed set of all of them);
* an item that is a rule by itself leaves the baskets, as whatever holds it holds a rule.

What is left goes to Spark's FP-growth while the combinations it may list are bounded by ``LATTICE`` (counted: each
distinct basket of k items has 2^k). Beyond that, nested urls make it list combinations of equal support without end;
then ``grow`` finds the same rules level by level, extending only combinations rarer than all of their parts.

Urls are matched by an inverted index: each rule stands under its token that is rarest among labelled urls; urls
join on tokens and keep the rules whose tokens they hold all. A url matched by a fixed rule takes the longest rule's
verdict; any other is blocked if an association rule matches, and allowed otherwise. Labels belong to a page whose
page_id is the label's doc_id: bad is quality 0 or toxic 1.

Nulls and edges: a null url, or one without "://", has empty host and path, no tokens, no rule and is
allowed; null labels count as not bad; with fewer than MIN_COUNT bad urls (or an empty table) no rules are mined. Rows that
repeat are judged each. Extra columns are ignored. Nothing is collected to the driver but counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SALTS, Scratch, attach_by_key, salt_of

#: (rule, verdict): host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Urls that must hold a combination at least, however few labels there are.
MIN_COUNT = 5
#: Standard deviations by which the bad urls of a combination must exceed the share of bad urls among all labelled ones; 0 leaves the
#: choice to support and confidence.
MIN_SURPRISE = 0.0
#: Combinations that FP-growth may have to list.
LATTICE = 1 << 18
BAD = "class=bad"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """(host, path) columns; both empty without '://'."""
    has = url.isNotNull() & (F.instr(url, "://") > 0)
    rest = F.substring_index(url, "://", 1)
    rest = url.substr(F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, _UP, _LOW)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens_of(url, host, path):
    """Distinct tokens of a url: host labels (h:), path words (p:), query keys (q:)."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(path, r"[^\p{L}\p{N}]+"), lambda x: ~x.rlike(r"^\d*$"))
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), F.lit(r"([^&=]+)=?[^&]*"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    parts = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(words, lambda x: F.concat(F.lit("p:"), F.lower(x))), keys)
    return F.array_distinct(parts)


def baskets(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(items, n, bad): the distinct token sets of labelled urls, with their urls and bad urls."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("_bad"))
    host, path = url_parts(F.col("url"))
    rows = pages.where("page_id is not null").select("page_id", F.array_sort(tokens_of(F.col("url"), host, path)).alias("items")).where(F.size("items") > 0)
    rows = rows.join(bad, rows["page_id"] == bad["doc_id"])
    return rows.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("bad"))


def _holds(total: int, bad: int, min_count: int, min_confidence: float, min_surprise: float):
    """Whether a combination in ``n`` urls, ``bad`` of them bad, is a rule."""
    p = bad / total
    rule = (F.col("bad") >= min_count) & (F.col("bad") >= F.col("n") * min_confidence)
    return rule & ((F.col("bad") - F.col("n") * p) >= min_surprise * F.sqrt(F.col("n") * (p * (1 - p)))) if min_surprise else rule


def by_growth(rows: DataFrame, total: int, min_count: int) -> DataFrame:
    """(items, n, bad) of all combinations of two items or more in ``min_count`` bad rows, by FP-growth."""
    each = rows.select("items", F.explode(F.concat(F.array_repeat(F.lit(True), F.col("bad").cast("int")), F.array_repeat(F.lit(False), (F.col("n") - F.col("bad")).cast("int")))).alias("_bad"))
    each = each.select(F.concat("items", F.when(F.col("_bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    # half a row less, as the bound is a share in floating point
    sets = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / total).fit(each).freqItemsets
    of_bad = sets.where(F.array_contains("items", BAD)).select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("bad"))
    of_all = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    return of_bad.where(F.size("items") > 1).join(of_all, "items").select("items", "n", "bad")


def grow(rows: DataFrame, single: DataFrame, holds, min_count: int, scratch: Scratch) -> DataFrame | None:
    """(items, n, bad) of the smallest rules of two items or more, level by level.

    A combination in as many rows as one of its parts stands in the same rows, so it is a rule only if the part is; it and all
    that contain it are left out, as are those that contain a rule. ``single``: (item, n) of the items of ``rows``."""
    parts = single.select(F.array("item").alias("items"), "n")
    held = rows.where("bad > 0").select(F.col("items").alias("_all"), "n", "bad", F.explode("items").alias("_i")).select("_all", F.array("_i").alias("items"))
    rules, level = [], 1
    while True:
        level += 1
        more = held.select("_all", "items", F.explode(F.filter("_all", lambda x: x > F.element_at("items", -1))).alias("_i"))
        seen = more.select(F.concat("items", F.array("_i")).alias("items")).distinct()
        # every part of a candidate must have survived; then its rows are counted over all baskets
        subsets = seen.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda k: F.filter("items", lambda x, i: i != k - 1))).alias("_part"))
        least = subsets.join(parts.withColumnRenamed("items", "_part"), "_part").groupBy("items").agg(F.count(F.lit(1)).alias("_k"), F.min("n").alias("_least")).where(F.col("_k") == level)
        key = F.element_at("items", 1)
        found = rows.select(F.col("items").alias("_all"), "n", "bad", F.explode("items").alias("_key")).join(least.select("items", "_least", key.alias("_key")), "_key")
        found = found.where(F.size(F.array_except("items", "_all")) == 0).groupBy("items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("_least").alias("_least"))
        found = scratch.store(found.where((F.col("bad") >= min_count) & (F.col("n") < F.col("_least"))).withColumn("_rule", holds), f"grow{level}")
        rules.append(found.where("_rule").select("items", "n", "bad"))
        parts = found.where("not _rule").select("items", "n")
        if parts.isEmpty():
            return reduce(DataFrame.unionByName, rules)
        wide = rows.where("bad > 0").select(F.col("items").alias("_all"), F.explode("items").alias("_key")).join(parts.select("items", key.alias("_key")), "_key")
        held = wide.where(F.size(F.array_except("items", "_all")) == 0).select("_all", "items")


def smallest(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose ``items`` contain no other row's."""
    inside = found.select(F.element_at("items", 1).alias("_key"), F.col("items").alias("_short"))
    longer = found.select("items", F.explode("items").alias("_key")).join(inside, "_key")
    longer = longer.where((F.size("_short") < F.size("items")) & (F.size(F.array_except("_short", "items")) == 0)).select("items").distinct()
    return found.join(longer, "items", "left_anti")


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, lattice: int = LATTICE, min_surprise: float = MIN_SURPRISE) -> DataFrame:
    """(key, tokens, confidence, support) of the smallest association rules for the bad class."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-rules")
    rows = scratch.store(baskets(pages, labels), "baskets")
    t = rows.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if (t["bad"] or 0) < MIN_COUNT:
        return spark.createDataFrame([], "key string, tokens array<string>, confidence double, support double")
    total, n_bad = t["n"], t["bad"]
    min_count = max(MIN_COUNT, -int(-min_support * total // 1))
    holds = _holds(total, n_bad, min_count, min_confidence, min_surprise)
    # tokens that stand in the same baskets are one item, named by the least of them
    at = rows.select(F.explode("items").alias("t"), "n", "bad", F.xxhash64("items").alias("_h"), F.xxhash64("items", F.lit(1)).alias("_g"))
    per = at.groupBy("t").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.bit_xor("_h").alias("_h"), F.bit_xor("_g").alias("_g")).where((F.col("bad") >= min_count) & (F.col("n") < total))
    items = per.groupBy("n", "bad", "_h", "_g").agg(F.min("t").alias("item"), F.array_sort(F.collect_list("t")).alias("tokens"))
    items = scratch.store(items.select("item", "tokens", "n", "bad", holds.alias("_rule")), "items")
    one = items.where("_rule").select(F.array("item").alias("items"), "n", "bad")
    rest = items.where("not _rule").select("item", "n")
    named = F.broadcast(rest) if rest.count() <= BROADCAST_ROWS else rest
    # each basket counts once although it is taken apart: it is named by its own token set
    left = rows.select("n", "bad", F.col("items").alias("_b"), F.explode("items").alias("item")).join(named.select("item"), "item")
    left = left.groupBy("_b", "n", "bad").agg(F.array_sort(F.collect_list("item")).alias("items")).groupBy("items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    left = scratch.store(left.where(F.size("items") > 1), "reduced")
    lists = left.agg(F.sum(F.pow(F.lit(2.0), F.size("items")))).first()[0] or 0
    if not lists:
        found = one
    elif lists <= lattice:
        found = one.unionByName(smallest(scratch.store(by_growth(left, left.agg(F.sum("n")).first()[0], min_count).where(holds), "grown")))
    else:
        found = one.unionByName(grow(left, rest, holds, min_count, scratch))
    # every item as all of its tokens; the rule stands under the one in the fewest labelled urls
    each = found.select("*", F.explode("items").alias("item")).join(items.select("item", "tokens", F.col("n").alias("_n")), "item")
    out = each.groupBy("items", "n", "bad").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.min_by("item", F.struct("_n", "item")).alias("key"))
    out = out.select("key", "tokens", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(total)).alias("support"))
    return scratch.store(out, "rules")


def judge(pages: DataFrame, mined: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    n_rules = mined.count()
    by_rule = F.lit(None).cast("string")
    for rule, verdict in RULES:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    if not n_rules:
        return rows.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.lit("allow")).alias("verdict"))
    open_urls = rows.where("rule is null and host <> ''").select("url", "host", "path").distinct()
    tokens = open_urls.select("url", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("_tokens"))
    held = tokens.select("url", "_tokens", F.explode("_tokens").alias("key"))
    if n_rules <= BROADCAST_ROWS:
        held = held.join(F.broadcast(mined), "key")
    else:  # a frequent token is dealt over salts
        dealt = mined.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("_salt", salt_of("url")).join(dealt, ["key", "_salt"])
    hit = held.where(F.size(F.array_except("tokens", "_tokens")) == 0)
    blocked = hit.select("url").distinct().withColumn("_hit", F.lit(True))
    out = attach_by_key(rows, blocked, "url", ["page_id"])
    mined_verdict = F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, mined_verdict).alias("verdict"))
