"""Queries, preprocessing and sampling over large collections of sparse cell by gene data on Spark."""
