"""Operators for training data. Nothing else in this package imports this folder."""
