"""Whole plans: collation, preprocessing, data module."""
