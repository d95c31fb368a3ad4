"""Incremental ingest of product shards and refresh of the best-record table."""
