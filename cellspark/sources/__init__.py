"""Reading and writing of collections, genes and metadata."""
