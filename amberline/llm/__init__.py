"""Operators for large text corpora: deduplication, decontamination, scoring, packing.

Nothing outside this subpackage imports it. ``registry`` holds its queries and SQL.
"""
