"""The opN queries: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, collocations, embedding_dups, exact_dedup, html_wrappers, importance, jaccard_join, line_dedup, mixing, quality_bt, sentencepiece, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Default path of the vocabulary file, from the installed package of public tokenizers."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op2_embedding_dups(spark, sf_dir):
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.mine_rules(pages, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark, sf_dir, vocabulary_path: str | None = None):
    pieces, prefix = sentencepiece.read_model(vocabulary_path or vocabulary())
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), sentencepiece.Unigram(pieces, prefix))


def op8_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_wrappers.extract_pages(pages, html_wrappers.rules(html_wrappers.levels(pages)))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_bt.classify(docs, quality_bt.train(docs, table(spark, sf_dir, "labels")))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_importance(spark, sf_dir):
    return importance.digest(importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_chat_format(spark, sf_dir):
    return chat_format.round_trip(chat_format.with_hard_conversation(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_embedding_dups, op3_warc, op4_jaccard_join, op5_mix_sources, op6_url_filter, op7_sentencepiece, op8_main_text, op9_exact_dedup, op10_quality, op11_collocations, op12_importance, op13_chat_format)}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op2_embedding_dups": embedding_dups.ORACLE, "op3_warc": warc.ORACLE, "op4_jaccard_join": jaccard_join.ORACLE, "op5_mix_sources": mixing.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_collocations": collocations.ORACLE, "op12_importance": importance.ORACLE, "op13_chat_format": chat_format.ORACLE}
