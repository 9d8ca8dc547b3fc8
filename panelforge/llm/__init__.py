"""Operators for training-data pipelines: tokens, deduplication, classifiers, chat formatting, packing and search."""
