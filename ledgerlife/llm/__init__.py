"""Corpus operators for training data: cleaning, deduplication, mixing, tokens and search."""
