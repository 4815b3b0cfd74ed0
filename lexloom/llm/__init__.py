"""Operators for training-data pipelines: classifiers, fingerprints, deduplication, search,
tokenisation and packing. Nothing else in the library imports this package."""
