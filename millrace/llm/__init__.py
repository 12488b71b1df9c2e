"""Training-data operators: sharding, counting, dedup, PII, packing, quality, mixing, search, language."""
