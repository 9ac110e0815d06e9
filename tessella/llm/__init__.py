"""Corpus operators for training-data pipelines."""
