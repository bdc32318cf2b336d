"""Training-data operators: tokens, language, fingerprints, toxicity, quality,
shards, near duplicates, mixtures, byte-level BPE and exact duplicates.

Nothing else in the library imports this subpackage.
"""
