"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, tokenizing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as
the next stage's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import jaccard_join, line_dedup, mixing, quality_bt, sentencepiece
from strandframe.llm.common import Scratch
from strandframe.llm.queries import table, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ranker = quality_bt.train(docs, table(spark, sf_dir, "labels"))
    return quality_bt.keep_good(docs, ranker)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay only in the smallest doc_id; n_chars is set anew."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice. A document without words has
    nothing to take and stays once."""
    rows = mixing.with_copies(docs, "_mix_copies", "_mix_size")
    times = F.when(F.col("_mix_size") == 0, 1).otherwise(F.col("_mix_copies")).cast("int")
    return rows.withColumn("_mix_k", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    pieces, prefix = sentencepiece.read_model(vocabulary())
    return sentencepiece.encode_documents(docs, sentencepiece.Unigram(pieces, prefix))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
#: The classifier, the closure of near copies and Viterbi paths are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` of ``sf_dir``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.store(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
