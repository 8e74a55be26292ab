"""Operators on cells, genes, labels and neighbours."""
