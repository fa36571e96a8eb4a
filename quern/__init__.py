"""Quern: document retrieval, ranking and evaluation analytics as PySpark plans."""
