"""Training-data operators: scoring, mixing, private data, media, classifiers, near-duplicates, tokens.

Nothing outside this folder imports it; ``registry.QUERIES`` and ``registry.ORACLES`` are what the entry file adds.
"""
