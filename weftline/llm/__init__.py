"""Training-data operators: scoring, filtering, deduplication, packing, sharding, tokenising.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
