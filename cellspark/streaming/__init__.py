"""Ingestion of new artifacts as a stream."""
