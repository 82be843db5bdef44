"""Append-only ingestion of a stream of batches."""
