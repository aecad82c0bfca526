"""Operators for training-data pipelines: dedup, decontamination, tokens, classifiers, privacy, search."""
