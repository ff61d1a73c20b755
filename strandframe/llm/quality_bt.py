"""Quality classifier: Bradley-Terry pairwise ranking over text statistics and learnt n-grams.

Features are of the whole text alone: statistics (character classes, word lengths, repeats, symbols), and log odds of its
words, word pairs and byte 4-grams. The odds of an n-gram (hashed to ``BUCKETS``) come from the labelled texts that hold it;
a text the model is fitted on sees only odds from the other half of those texts, so none knows its own label.
From labelled rows outside the held-out fifth, preference pairs (a label-1 text over a label-0 text) are
drawn; weights minimise the logistic loss on feature differences. The cut is a quantile of the training
scores, at the share of label 0, and the raw score is moved so that the cut lies at ``CUT`` = 0.3.

Fit on a bounded sample: at most ``MAX_FIT`` labelled documents, chosen by a hash of doc_id, and 2 MAX_FIT rows of them, by a hash of
the row; what reaches the driver is at most that many times FEATURES doubles, and the counts of the n-gram buckets. Scoring is
a map over all rows and whole texts.

Nulls and edges: null text counts as empty; a null label, or labels of one document that disagree, are left
out; rows repeating a doc_id are scored each; without both labels every score is 0.5. Empty table: empty
result. Extra columns are ignored (``classify``) or kept (``keep_good``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .jaccard_join import _mix, _word_hashes

#: Labelled rows that the model is fitted on at most, preference pairs drawn from them, and the cut.
MAX_FIT = 20_000
PAIRS = 200_000
CUT = 0.3
HELD_OUT = 5

_SYMBOLS = b"!%$&*#|@=<>{}[]\\^~_/+"
_PUNCT = b".,;:?'\"()-"
_CLASS = np.zeros(256, np.int8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() and _b < 128 else 4 if _b in b" \t\r\x0b\x0c" else 5 if _b == 10 else 6 if _b in _SYMBOLS else 7 if _b in _PUNCT else 8 if _b >= 128 else 0
STATISTICS = 28
#: Buckets of each kind of n-gram; kinds: words, word pairs, byte 4-grams. Two features a kind.
BITS, KINDS = 14, 3
BUCKETS = 1 << BITS
FEATURES = STATISTICS + 2 * KINDS
#: Share of the n-grams of a text that the second feature of a kind looks at: those that speak most against it.
WORST = 0.1


def grams(text: str | None) -> list[np.ndarray]:
    """Distinct buckets of the n-grams of a whole text, by kind."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = _word_hashes(raw)
    pairs = _mix(w[:-1] * np.uint64(3) + w[1:])
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    four = (b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    seen = np.zeros((KINDS, BUCKETS), bool)
    for row, at in zip(seen, (w & np.uint64(BUCKETS - 1), pairs & np.uint64(BUCKETS - 1), four), strict=True):
        row[at] = True
    return [np.flatnonzero(row) for row in seen]


def log_odds(counts: np.ndarray) -> np.ndarray:
    """(kinds, buckets) log odds of label 1 from (label, kinds, buckets) numbers of texts that hold a bucket."""
    n = np.maximum(counts.max((1, 2), keepdims=True), 1)
    rate = (counts + 1) / (n + 2)
    return np.log(rate[1]) - np.log(rate[0])


def gram_features(text: str | None, odds: np.ndarray) -> np.ndarray:
    """Mean log odds of a text's n-grams, and of the worst of them, by kind."""
    out = np.zeros(2 * KINDS)
    for k, at in enumerate(grams(text)):
        if len(at):
            x = odds[k, at]
            few = max(1, int(len(x) * WORST))
            out[2 * k], out[2 * k + 1] = x.mean(), np.partition(x, few - 1)[:few].mean()
    return out


def features(text: str | None, odds: np.ndarray) -> np.ndarray:
    """Feature vector of a whole text; zeros for an empty one."""
    return np.concatenate([statistics(text), gram_features(text, odds)])


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; zeros for an empty one."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(STATISTICS)
    words = (text or "").split()
    n, w = len(raw), len(words)
    if not w:
        return out
    share = np.bincount(_CLASS[raw], minlength=9) / n
    lengths = np.fromiter(map(len, words), np.int64, w)
    unique = len(set(words))
    codes = np.fromiter(map(hash, words), np.int64, w)
    same = float((codes[1:] == codes[:-1]).mean()) if w > 1 else 0.0
    pairs = codes[:-1] * 1_000_003 + codes[1:]
    pair_rate = len(np.unique(pairs)) / max(1, w - 1)
    lines = text.split("\n")
    ends = _CLASS[raw[np.flatnonzero(share_mask(raw))]] if n > 1 else np.zeros(1, np.int8)
    last_symbol = float(np.isin(ends, (6,)).mean()) if len(ends) else 0.0
    upper = share[2] / max(1e-9, share[1] + share[2])
    counts = np.unique(codes, return_counts=True)[1]
    out[:9] = share
    out[9:] = (
        upper,
        np.log1p(w),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        unique / w,
        np.log(unique / w),
        same,
        pair_rate,
        np.log(max(pair_rate, 1e-6)),
        counts.max() / w,
        len(set(lines)) / len(lines),
        last_symbol,
        np.log(1e-3 + share[6]),
        np.log(1e-3 + upper),
        np.log(1e-3 + same),
        np.log(1e-3 + share[7]),
        (lengths == 1).mean(),
        np.log(1e-3 + share[3]),
        np.log1p(w / len(lines)),
    )
    return out


def share_mask(raw: np.ndarray) -> np.ndarray:
    """True at the last byte of every word."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = np.empty(len(raw), bool)
    last[:-1] = ~space[:-1] & space[1:]
    last[-1] = not space[-1]
    return last


class Ranker:
    """Fitted Bradley-Terry scorer: score(x) = sigmoid(w . (x - mean) / sd - cut + logit(CUT))."""

    def __init__(self, mean=None, sd=None, w=None, cut=None, odds=None):
        self.mean, self.sd, self.w, self.cut = mean, sd, w, cut
        self.odds = np.zeros((KINDS, BUCKETS)) if odds is None else odds

    def texts(self, texts: list) -> np.ndarray:
        """Scores of texts."""
        if self.w is None:
            return np.full(len(texts), 0.5)
        return self.score(np.array([features(t, self.odds) for t in texts]).reshape(-1, FEATURES))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), 0.5)
        z = np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -60, 60)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, odds: np.ndarray | None = None, seed: int = 7, steps: int = 400, l2: float = 1e-4) -> Ranker:
    """Weights by gradient steps on log(1 + exp(-w . (x_better - x_worse))) over drawn preference pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker()
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / sd, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(PAIRS, 40 * len(x))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    batch = min(n, 8192)
    for k in range(1, steps + 1):
        at = (k * batch) % max(1, n - batch + 1)
        d = diff[at : at + batch]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -50, 50))))[:, None]).mean(0) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    raw = z @ w
    return Ranker(mean, sd, w, float(np.quantile(raw, (y == 0).mean())), odds)


def _count_grams(batches):
    """(slot, n): labelled texts that hold a bucket, by half, label, kind and bucket."""
    counts = np.zeros((2, 2, KINDS, BUCKETS), np.int64)
    for b in batches:
        for half, y, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k, at in enumerate(grams(text)):
                counts[half, y, k, at] += 1
    flat = counts.ravel()
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], ["slot", "n"])


def _rows_of(odds: np.ndarray):
    """Kernel: features of labelled texts, with the odds of the other half."""

    def run(batches):
        for b in batches:
            x = [features(t, odds[1 - half]).tolist() for half, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return run


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT)) == 0


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on at most MAX_FIT labelled rows that are not held out."""
    clear = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    clear = clear.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_top")).where("y = _top and y in (0, 1)")
    n = clear.count()
    picked = clear.select(F.col("doc_id").alias("_id"), "y")
    if n > MAX_FIT:
        picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(MAX_FIT)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half"), F.col("y").cast("int").alias("y"), "text", F.xxhash64("doc_id", "text").alias("_h"))
    rows = Scratch(docs.sparkSession, "quality").store(rows, "labelled")
    if rows.count() > 2 * MAX_FIT:  # repeated ids
        rows = rows.orderBy("_h", "text").limit(2 * MAX_FIT)
    rows = rows.select("half", "y", "text")
    held = rows.mapInArrow(_count_grams, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * 2 * KINDS * BUCKETS)
    counts[held.column("slot").to_numpy()] = held.column("n").to_numpy()
    counts = counts.reshape(2, 2, KINDS, BUCKETS)
    got = rows.mapInArrow(_rows_of(np.array([log_odds(c) for c in counts])), "y int, x array<double>").toArrow()
    if not got.num_rows:
        return Ranker()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y = got.column("y").to_numpy()
    order = np.lexsort([*x.T, y])  # the same fit in whatever order rows arrive
    return fit(x[order], y[order], log_odds(counts.sum(0)))


def classify(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ranker.texts(b.column(1).to_pylist()))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    out = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` that score at least CUT, all columns as they are."""
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(ranker.texts(b.column(at).to_pylist()) >= CUT))

    return docs.mapInArrow(keep, docs.schema)
