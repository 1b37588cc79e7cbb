"""Training-data operators: filtering, mixing, deduplication, scanning, tokenising and scoring of document tables.

Nothing outside this subpackage imports it.
"""
