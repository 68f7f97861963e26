"""Operators of a training-data pipeline: search, cleaning, scoring and packing of document tables.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the thin
queries with fixed output contracts are in :mod:`pairloom.llm.queries`.
"""
