"""Operators for preparing training text: deduplication, filters, tokens, shards and chat logs.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
