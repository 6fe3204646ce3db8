"""Operators for large text corpora: deduplication, tokenization, classification, scans.

Nothing outside this subpackage imports it.
"""
