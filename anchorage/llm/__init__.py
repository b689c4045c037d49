"""Training-data operators: deduplication, filtering, extraction, mixing and search.

Nothing outside this subpackage imports it.
"""
