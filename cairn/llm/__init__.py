"""Training-data operators: sanitising, deduplication, filtering, mixing and token output.

Nothing outside this subpackage imports it.
"""
