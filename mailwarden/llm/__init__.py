"""Operators for training-data corpora. Nothing outside this package imports it but __spark_entry__."""
