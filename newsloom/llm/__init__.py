"""Operators for large text collections: near-duplicates, names, sentences, clean-up, packing, leaks, shared spans."""
