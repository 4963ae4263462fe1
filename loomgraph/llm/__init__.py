"""Corpus operators for training data: one module per operator, queries in ``queries``."""
