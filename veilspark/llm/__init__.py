"""Operators of a training-data pipeline: near-duplicates, licences, mixing, tokens, secrets,
quality, toxicity and fingerprints. Nothing else in the library imports this package."""
