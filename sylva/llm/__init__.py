"""Training-data pipeline operators: sharding, WARC, dedup, quality, language, tokens, mixing, toxicity, passages, leaks.

Nothing else in the library imports this subpackage.
"""
