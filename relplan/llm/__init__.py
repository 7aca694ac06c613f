"""Training-data operators: deduplication, decontamination, scoring, search and mixing.

Nothing outside this subpackage imports it.
"""
