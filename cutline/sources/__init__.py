"""Readers and sinks. Each reader parses a raw string table, so files, streams and tables share it."""
