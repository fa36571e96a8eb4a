"""Operators that prepare training data from whole corpora."""
