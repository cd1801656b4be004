"""Operators for preparing training data at scale: tokens, quality, duplicates, media, urls, shards.

Nothing outside this package imports it. Every operator takes and returns DataFrames; the queries
registered for the driver are in ``queries.py``.
"""
