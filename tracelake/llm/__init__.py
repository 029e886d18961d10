"""Operators for preparing training text: search, deduplication, quality, extraction and mixing.

Nothing outside this subpackage imports it.
"""
