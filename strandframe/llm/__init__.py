"""Operators of a training-data pipeline: dedup, filtering, mixing, archives, tokenizing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
