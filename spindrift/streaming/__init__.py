"""Streaming ingest of vectors and deletions."""
