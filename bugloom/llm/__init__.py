"""Operators for training-data pipelines: documents, web pages, labels, token files."""
