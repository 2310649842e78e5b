"""Operators for training-text corpora. Nothing else in the package imports this folder."""
