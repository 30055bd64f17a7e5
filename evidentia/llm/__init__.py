"""Operators for training-data pipelines over the tables documents, pages, benchmark, labels and conversations."""
