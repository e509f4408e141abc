"""Training-data operators: sharding, tokens, mixing, deduplication, quality and toxicity.

Nothing else in the library imports this subpackage.
"""
