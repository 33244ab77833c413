"""Operators of a training-data pipeline: token counts, quality rules, language
model scores, WARC files, source mixing, chat formatting, byte-level BPE,
n-gram similarity joins, embedding near-duplicates and substring removal.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
