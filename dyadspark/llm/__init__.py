"""Training-data operators: tokens, deduplication, filtering, mixing, packing, archives.

Nothing outside this subpackage imports it.
"""
