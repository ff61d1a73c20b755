"""Importance resampling towards a target distribution by hashed n-gram counts.

Each task counts with DuckDB: SQL unnests the words of its rows, windows them into n-grams, and hashes the distinct ones
with zlib's CRC-32, a function registered with the connection. What comes out are bucket counts, a row a document, which Spark
writes to Parquet in the shared folder; texts are read once and n-grams are never shuffled. Spark merges the counts of corpus
and target into one gain a bucket, scores each document's stored counts with them, and draws.

The draw is a Gumbel top-k: a document's score is its mean gain plus noise from a hash of its id. Scores are whole numbers, so
two histograms (by score / 1024, then within one of those) find the score of the last document drawn; only documents from
there on are ranked, over range partitions.

Texts pass through DuckDB ``CHUNK`` characters at a time (a longer text alone), so its memory does not grow with the partition. A document's
counts have at most ``buckets`` entries. The only thing collected are the ``buckets`` gains and the two histograms.

Nulls: a null or empty text has no features and weight 0; a null doc_id is hashed like the empty string and comes last among ties. Repeated
rows score alike and are ranked one after the other. An empty target leaves gains that depend on the corpus only; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_parts
from .mixing import prefix_sums

BUCKETS = 10_000
#: Words in a row that make a feature, from and to.
NGRAMS = (1, 1)
MIN_WORDS = 20
#: Share of the documents of MIN_WORDS that is drawn, in percent.
PERCENT = 10
SEED = 2024
#: Characters that are no part of a word, once A-Z are lower case.
NO_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 4 << 20
COUNTED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
#: DuckDB's memory in a task.
DUCK_MEMORY = "600MB"


def _crc32(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.int64())


def counting_sql(ngrams: tuple[int, int], buckets: int) -> str:
    """Per row of ``chunk`` (r, text): number of words, and (bucket, count) of its n-grams."""
    ahead = lambda k: f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i)"
    gram = lambda n: " || ' ' || ".join(["word", *[ahead(k) for k in range(1, n)]])
    grams = " UNION ALL ".join(f"SELECT r, {gram(n)} AS gram FROM words" for n in range(ngrams[0], ngrams[1] + 1))
    return rf"""
    WITH split AS (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{NO_WORD}]+') AS w FROM chunk),
    words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
    grams AS ({grams}),
    per AS (SELECT r, gram, count(*) AS c FROM grams WHERE gram IS NOT NULL GROUP BY r, gram),
    codes AS (SELECT gram, crc32(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM per)),
    summed AS (SELECT r, bucket, sum(c) AS c FROM per JOIN codes USING (gram) GROUP BY r, bucket),
    lists AS (SELECT r, list(bucket::INT ORDER BY bucket) AS buckets, list(c::INT ORDER BY bucket) AS counts, sum(c)::BIGINT AS n FROM summed GROUP BY r)
    SELECT r, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(buckets, []::INT[]) AS buckets, coalesce(counts, []::INT[]) AS counts
    FROM split LEFT JOIN lists USING (r) ORDER BY r"""


def _chunks(texts: pa.Array, size: int):
    """(start, stop) of runs of texts of about ``size`` bytes."""
    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > size:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(docs: DataFrame, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, id_column: str = "doc_id") -> DataFrame:
    """COUNTED of (id, text): how often each bucket occurs among the n-grams of each text."""
    sql = counting_sql(ngrams, buckets)

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": ""})
        con.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            for start, stop in _chunks(texts, CHUNK):
                con.register("chunk", pa.table({"r": pa.array(range(stop - start), pa.int64()), "text": texts.slice(start, stop - start)}))
                out = con.sql(sql).to_arrow_table()
                con.unregister("chunk")
                cols = [b.column("doc_id").slice(start, stop - start), *[out.column(k).combine_chunks() for k in _COUNTED.names[1:]]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _COUNTED, strict=True)], schema=_COUNTED)
        con.close()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def merged(counted: DataFrame, name: str) -> DataFrame:
    """(bucket, <name>) of all rows."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor of 1000 times the log of target share by corpus share, both with one more in each bucket."""
    t = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for part, name in ((merged(corpus, "s"), "s"), (merged(target, "t"), "t")):
        t = t.join(part, "bucket", "left").fillna(0, [name])
    total = lambda x: F.sum("n_features").alias(x)
    sums = [F.lit(float(d.agg(F.coalesce(total("n"), F.lit(0))).first()[0]) + buckets) for d in (corpus, target)]
    plus = lambda c: F.col(c).cast("double") + 1
    return t.select("bucket", F.floor(1000 * F.log(plus("t") * sums[0] / (plus("s") * sums[1]))).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(counted: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of stored counts. ``gain`` has a row a bucket and becomes a constant of the plan."""
    values = ",".join(str(r["gain"]) for r in gain.orderBy("bucket").collect())
    table = F.split(F.lit(values), ",").cast("array<bigint>")
    each = F.zip_with("buckets", "counts", lambda b, c: F.element_at(table, b + 1) * c)
    total, n = F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x), F.col("n_features")
    t = counted.withColumn("_sum", total)
    weight = F.when(n > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(0).cast("long")
    return t.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"))


def _lowest_drawn(rows: DataFrame, draw: int) -> int:
    """The score of the ``draw``-th row from the top, by histograms of at most a few hundred and 1024 rows."""
    above, span, low = 0, 1024, None
    for width in (span, 1):
        inside = rows if low is None else rows.where((F.col("score") >= low) & (F.col("score") < low + span))
        hist = inside.groupBy(F.floor(F.col("score") / width).alias("b")).count().collect()
        for b, c in sorted(map(tuple, hist), reverse=True):
            if above + c >= draw:
                low = b * width
                break
            above += c
    return low


def drawn(rows: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` (1 is the highest score) to stored rows of ``scored``: of those with ``min_words``, ``percent`` of a hundred."""
    fit = rows.where(F.col("n_words") >= min_words)
    draw = percent * fit.count() // 100
    nothing = rows.withColumn("rank", F.lit(None).cast("long"))
    if not draw:
        return nothing
    fits = (F.col("n_words") >= min_words) & (F.col("score") >= _lowest_drawn(fit, draw))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    top = rows.withColumn("_row", F.monotonically_increasing_id()).where(fits)
    top = prefix_sums(top, order, {"_k": F.lit(1)}, scratch, "top", shuffle_parts(rows.sparkSession))
    top = top.select(*rows.columns, F.when(F.col("_k") < draw, F.col("_k") + 1).cast("long").alias("rank"))
    return nothing.where(~fits).unionByName(top)


def resample(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, target_id: str = "item_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of ``docs`` (doc_id, text), drawn to be like ``target`` (text)."""
    scratch = Scratch(docs.sparkSession, "importance")
    corpus = scratch.store(bucket_counts(docs, ngrams, buckets), "corpus")
    wanted = scratch.store(bucket_counts(target, ngrams, buckets, target_id), "target")
    gain = scratch.store(gains(corpus, wanted, buckets).coalesce(1), "gains")
    rows = scratch.store(scored(corpus, gain, seed), "scored")
    scratch.drop("corpus", "target")
    return drawn(rows, scratch, min_words, percent).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = rf"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
w AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{NO_WORD}]+')) AS word FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{NO_WORD}]+')) FROM benchmark),
bytes AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)),
codes AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)),
  lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, bits),
hist AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM w JOIN codes USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1) * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM hist),
per AS (SELECT id AS doc_id, count(*) AS n, sum(gain) AS g FROM w JOIN codes USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
base AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN ((g - ((g % n) + n) % n) // n)::BIGINT ELSE 0 END AS weight,
  ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN per USING (doc_id)),
scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM base),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= {MIN_WORDS})
SELECT s.doc_id, s.n_features, s.weight, s.score, r.rank FROM scores s LEFT JOIN ranks r ON r.doc_id = s.doc_id AND r.rank <= {PERCENT} * r.n // 100
"""
