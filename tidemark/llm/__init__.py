"""Operators for large text corpora: scoring, duplicate search, retrieval, sanitising and tokenising.

Nothing outside this folder imports it.
"""
