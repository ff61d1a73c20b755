"""Phrase collocation mining over dictionary-encoded words.

1. Blocks. Texts are cut into pieces and words once, in blocks of some ``BLOCK`` characters of one language. A block keeps its words as
   codes of its own small dictionary, with a break between pieces, and that dictionary with counts. Blocks are written to the shared folder.
2. Dictionary. The blocks' dictionaries are summed by (lang, word). Words of at least ``min_count`` occurrences are numbered in
   order of (lang, word) over range partitions; a number thus also says the language. No dictionary is broadcast or collected:
   every block's own words meet it by a join, and the block gets the numbers of its codes. Rarer words become breaks, as no
   phrase that holds one can be frequent.
3. N-grams. Runs of numbers are packed into binary keys of four big-endian bytes a word. A task sorts its keys by radix (16 bits a pass)
   and counts runs, some millions of keys at a time, so a phrase that is everywhere leaves a task once. The key range is cut into
   slices of some ``SLICE`` occurrences at bounds taken from a few blocks; a task sends the keys of a slice as one packed row. Slices
   are dealt to tasks, which sort one slice after the other by radix and add up its runs: memory follows the slice, not the table.
4. Scores. Candidates of m words meet the counts of their parts by salted joins, shortest first, in decimals of 38 digits.
5. A candidate inside a longer one of at least ``inside`` percent of its count goes; the first ``top`` of a language are
   chosen within salted shares of it, then among those.

Nulls: a null text is empty, a null ``lang`` is ``und``. Documents without words and an empty table give no phrases. Repeated rows
count each; ties of score and count are ordered by phrase in UTF-8 byte order. A text of any length is one row of a block.
Counts up to 10^16 are exact. More than 2^32 frequent words are an error. Other columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, Scratch, attach_by_key, salt_of, shuffle_parts
from .mixing import prefix_sums

MIN_COUNT, MAX_WORDS, INSIDE, TOP = 10, 3, 50, 2000
#: Between pieces, and between words of a piece.
PIECE_ENDS, WORD_ENDS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
BLOCK = 2 << 20
#: N-grams that a task sorts at once, and occurrences that a slice of the keys has about.
SORTED, SLICE = 6_000_000, 4_000_000
#: Blocks, about, of which some keys are collected to place the slices' bounds; they say how even slices are, not what is counted.
SAMPLED = 48
WIDTH = 4
BLOCKS = "block long, lang string, codes binary, n_codes long, words array<string>, counts array<long>"
_BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("n_codes", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_RUNS = pa.schema([("key", pa.binary()), ("a", pa.int64())])
_SLICES = pa.schema([("slice", pa.int32()), ("m", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes with -1 between pieces, words by code) of texts."""
    pieces = pc.list_flatten(pc.split_pattern_regex(pc.ascii_lower(texts), PIECE_ENDS))
    split = pc.split_pattern_regex(pieces, WORD_ENDS)
    words, of = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(words, "")
    words, of = words.filter(real), of.filter(real).to_numpy()
    d = words.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    return np.insert(codes, np.flatnonzero(np.diff(of)) + 1, -1), d.dictionary


def _blocks(batches):
    part, k = TaskContext.get().partitionId() << 32, 0
    codec = pa.Codec("zstd")
    for b in batches:
        for lang in pc.unique(b.column("lang")).to_pylist():
            texts = b.column("text").filter(pc.equal(b.column("lang"), lang))
            at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                codes, words = encoded(texts.slice(lo, hi - lo))
                if len(words):
                    counts = np.bincount(codes[codes >= 0], minlength=len(words))
                    row = [[part | k], [lang], [codec.compress(codes.tobytes(), asbytes=True)], [len(codes)], [words.to_pylist()], [counts]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)
                    k += 1


def blocks(docs: DataFrame) -> DataFrame:
    """BLOCKS of (lang, text)."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_blocks, BLOCKS)


def block_words(stored: DataFrame) -> DataFrame:
    """(block, lang, code, word, c) of the blocks' own dictionaries."""
    each = stored.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x"))
    return each.select("block", "lang", "code", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))


def dictionary(stored: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, word, a, id) of frequent words, stored; ids count from 0 in order of (lang, word)."""
    words = block_words(stored).groupBy("lang", "word").agg(F.sum("c").alias("a")).where(F.col("a") >= min_count)
    rows = prefix_sums(words, [F.col("lang"), F.col("word")], {"id": F.lit(1).cast("long")}, scratch, "ordered", shuffle_parts(stored.sparkSession))
    rows = scratch.store(rows.select("lang", "word", "a", "id"), "dictionary")
    scratch.drop("ordered")
    if rows.count() > 1 << 8 * WIDTH:
        raise ValueError("more frequent words than the keys can number; raise min_count")
    return rows


def radix_order(digits: np.ndarray) -> np.ndarray:
    """Order of rows of 16-bit digits, most significant first, by one stable counting pass a digit (numpy's sort of 16-bit numbers)."""
    order = np.arange(len(digits))
    for k in range(digits.shape[1] - 1, -1, -1):
        order = order[np.argsort(digits[order, k], kind="stable")]
    return order


def packed(ids: np.ndarray, m: int) -> np.ndarray:
    """Keys of all runs of ``m`` numbers in ``ids`` (negative: a break), as rows of big-endian 16-bit digits."""
    n = len(ids) - m + 1
    if n <= 0:
        return np.zeros((0, 2 * m), np.uint16)
    good = np.ones(n, bool)
    for k in range(m):
        good &= ids[k : k + n] >= 0
    at = np.flatnonzero(good)
    out = np.empty((len(at), 2 * m), np.uint16)
    for k in range(m):
        out[:, 2 * k], out[:, 2 * k + 1] = ids[at + k] >> 16, ids[at + k] & 0xFFFF
    return out


def runs(digits: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of their ``counts``), each key counting once if none are given."""
    order = radix_order(digits)
    digits = digits[order]
    new = np.ones(len(digits), bool)
    new[1:] = (digits[1:] != digits[:-1]).any(1)
    start = np.flatnonzero(new)
    own = np.diff(np.append(start, len(digits))) if counts is None else np.add.reduceat(counts[order], start) if len(start) else counts
    return digits[start], own.astype(np.int64)


def as_bytes(digits: np.ndarray) -> np.ndarray:
    """Keys as byte strings, which compare as the digits do; a key that another one goes on from comes before it."""
    return np.ascontiguousarray(digits.astype(">u2")).view(f"S{2 * digits.shape[1]}").ravel()


def _numbers(batches):
    """Numbers of the words of each block, breaks as -1."""
    codec = pa.Codec("zstd")
    for codes, n, numbered in (tuple(b.column(k)[i] for k in range(b.num_columns)) for b in batches for i in range(b.num_rows)):
        codes = np.frombuffer(codec.decompress(codes.as_buffer(), n.as_py() * 4), np.int32)
        number = np.full(int(max(codes.max(initial=0), 0)) + 2, -1, np.int64)  # code -1 finds the last one
        number[numbered.values.field("code").to_numpy()] = numbered.values.field("id").to_numpy()
        yield number[codes]


def _evenly(max_words: int, each: int):
    """``each`` keys of a block's sorted n-grams, at even distances."""

    def run(batches):
        for ids in _numbers(batches):
            for m in range(2, max_words + 1):
                keys = packed(ids, m)
                keys = keys[radix_order(keys)]
                keys = keys[np.linspace(0, len(keys) - 1, min(each, len(keys))).astype(int)] if len(keys) else keys
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(">u2").view(f"V{4 * m}").ravel().tolist(), pa.binary())], ["key"])

    return run


def _cut(max_words: int, bounds: list[bytes]):
    """Runs of n-grams of a task, cut at ``bounds``: a row (slice, words, n, keys, counts) for each slice that has keys."""

    def run(batches):
        codec, ends = pa.Codec("zstd"), np.array(bounds, f"S{WIDTH * max_words}")
        held, size = {m: [] for m in range(2, max_words + 1)}, 0

        def flushed():
            for m, parts in held.items():
                keys, counts = runs(np.concatenate(parts)) if parts else (packed(np.zeros(0), m), None)
                cuts = [0, *np.searchsorted(as_bytes(keys), ends).tolist(), len(keys)] if len(keys) else []
                rows = [(k, m, hi - lo, codec.compress(keys[lo:hi].T.tobytes(), asbytes=True), codec.compress(counts[lo:hi].tobytes(), asbytes=True)) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SLICES.types, strict=True)], schema=_SLICES)
                parts.clear()

        for ids in _numbers(batches):
            for m, parts in held.items():
                parts.append(packed(ids, m))
                size += len(parts[-1])
            if size >= SORTED:
                yield from flushed()
                size = 0
        yield from flushed()

    return run


def _added(min_count: int):
    """Sums of the runs of each slice, which come one slice after the other."""

    def run(batches):
        codec = pa.Codec("zstd")
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for (_, m), own in groupby(rows, lambda r: r[:2]):
            keys, counts = [], []
            for _, _, n, k, c in own:
                keys.append(np.frombuffer(codec.decompress(k, n * 4 * m), np.uint16).reshape(2 * m, n).T)
                counts.append(np.frombuffer(codec.decompress(c, n * 8), np.int64))
            keys, counts = runs(np.concatenate(keys), np.concatenate(counts))
            full = counts >= min_count
            raw = keys[full].astype(">u2").tobytes()
            found = pa.Array.from_buffers(pa.binary(WIDTH * m), int(full.sum()), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([found, pa.array(counts[full], pa.int64())], schema=_RUNS)

    return run


def phrase_counts(stored: DataFrame, words: DataFrame, scratch: Scratch, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(key, a) of phrases of 2 to ``max_words`` words with at least ``min_count`` occurrences."""
    parts = shuffle_parts(stored.sparkSession)
    own = block_words(stored).join(words.select("lang", "word", "id"), ["lang", "word"])
    numbered = scratch.store(own.groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("numbered")), "numbered")  # as many as a block has words
    rows = lambda part: part.select("block", "codes", "n_codes").join(numbered, "block").select("codes", "n_codes", "numbered")
    n, n_blocks = stored.agg(F.coalesce(F.sum("n_codes"), F.lit(0)), F.count(F.lit(1))).first()
    slices = max(4 * parts, n * (max_words - 1) // SLICE)
    some = stored.where(F.pmod(F.xxhash64("block"), F.lit(max(n_blocks // SAMPLED, 1))) == 0)
    sample = sorted(bytes(r["key"]) for r in rows(some).mapInArrow(_evenly(max_words, max(256, 4 * slices // SAMPLED)), "key binary").collect())
    bounds = sorted({sample[len(sample) * k // slices] for k in range(1, slices)}) if sample else []
    cut = rows(stored).mapInArrow(_cut(max_words, bounds), "slice int, m int, n long, keys binary, counts binary")
    return cut.repartition(parts, "slice").sortWithinPartitions("slice", "m").mapInArrow(_added(min_count), "key binary, a long")


def _part(key: Column, start: int, words: int) -> Column:
    return F.substring(key, start * WIDTH + 1, words * WIDTH)


def scored(found: DataFrame, words: DataFrame, scratch: Scratch, max_words: int = MAX_WORDS) -> DataFrame:
    """(key, lang, phrase, m, a, l, r, score) of stored phrase counts; a phrase has the values of its weakest cut."""
    key = F.unhex(F.lpad(F.hex("id"), 2 * WIDTH, "0"))
    parts = words.select(key.alias("part"), "lang", F.col("word").alias("phrase"), F.col("a").alias("f"))
    done = None
    for m in range(2, max_words + 1):
        own = found.where(F.length("key") == m * WIDTH).select("key", "a", F.explode(F.sequence(F.lit(1), F.lit(m - 1))).alias("cut"))
        left, right = ((F.substring("key", F.lit(1), F.col("cut") * WIDTH)), F.substring("key", F.col("cut") * WIDTH + 1, (m - F.col("cut")) * WIDTH))
        own = own.withColumns({"_left": left, "_right": right})
        for side in ("left", "right"):
            small = parts.select(F.col("part").alias(f"_{side}"), F.struct("lang", "phrase", "f").alias(side))
            own = attach_by_key(own, small, f"_{side}", ["key"])
        big = lambda c: F.col(c).cast("decimal(38,0)")
        own = own.select("key", "a", "cut", "left.lang", F.concat_ws(" ", "left.phrase", "right.phrase").alias("phrase"), F.col("left.f").alias("l"), F.col("right.f").alias("r"))
        own = own.withColumns({"_num": big("a") * big("a") * F.lit(1_000_000), "_den": big("l") * big("r")}).withColumn("score", F.expr("_num div _den"))
        own = own.groupBy("key").agg(F.min(F.struct("score", "cut", "lang", "phrase", "a", "l", "r")).alias("x"))
        own = scratch.store(own.select("key", "x.lang", "x.phrase", F.lit(m).alias("m"), "x.a", "x.l", "x.r", "x.score"), f"scored{m}")
        done = own if done is None else done.unionByName(own)
        parts = parts.unionByName(own.select(F.col("key").alias("part"), "lang", "phrase", F.col("a").alias("f")))
    return done


def not_inside(phrases: DataFrame, max_words: int = MAX_WORDS, inside: int = INSIDE) -> DataFrame:
    """Without phrases that a longer one holds which has ``inside`` percent of their count or more."""
    spans = [(m, k, n) for m in range(3, max_words + 1) for n in range(2, m) for k in range(m - n + 1)]
    held = F.flatten(F.array(*[F.when(F.col("m") == m, F.array(_part(F.col("key"), k, n))).otherwise(F.array()) for m, k, n in spans]))
    longest = phrases.where("m > 2").select(F.explode(held).alias("key"), F.col("a").alias("_a")).groupBy("key").agg(F.max("_a").alias("_longer")) if spans else None
    if longest is None:
        return phrases
    return phrases.join(longest, "key", "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < inside * F.col("a"))).drop("_longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    if max_words < 2:
        raise ValueError("a phrase has at least two words")
    scratch = Scratch(docs.sparkSession, "collocations")
    stored = scratch.store(blocks(docs), "blocks")
    words = dictionary(stored, scratch, min_count)
    found = scratch.store(phrase_counts(stored, words, scratch, max_words, min_count), "found")
    left = not_inside(scored(found, words, scratch, max_words), max_words, inside)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    totals = scratch.store(stored.select("lang", n.alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    scratch.drop("blocks", "numbered")
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    shares = left.withColumn("_salt", salt_of("key", salts=SALTS)).withColumn("_k", first("lang", "_salt")).where(F.col("_k") <= top)
    ranked = shares.withColumn("rank", first("lang")).where(F.col("rank") <= top)  # of at most SALTS * top rows a language
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, text FROM (SELECT lang, unnest(string_split_regex(text, '{PIECE_ENDS}')) AS text FROM docs)),
split AS (SELECT lang, piece, list_filter(string_split_regex(text, '{WORD_ENDS}'), lambda w: w <> '') AS ws FROM pieces),
w AS (SELECT lang, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM split),
nx AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY piece ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM nx GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM nx WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM nx WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, w1 AS x, w2 AS y, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, 1 AS k, f2.f AS a, p.f AS l, q.f AS r FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.w1 = f2.w1 JOIN f1 q ON q.lang = f2.lang AND q.w1 = f2.w2
    LEFT JOIN longer g ON g.lang = f2.lang AND g.x = f2.w1 AND g.y = f2.w2 WHERE g.f IS NULL OR 100 * g.f < {INSIDE} * f2.f
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 1, f3.f, p.f, q.f FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.w1 = f3.w1 JOIN f2 q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 2, f3.f, p.f, q.f FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f1 q ON q.lang = f3.lang AND q.w1 = f3.w3),
weakest AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l::HUGEINT * r), k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest QUALIFY rank <= {TOP})
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang)
"""
