"""Scans: product shards, registry, records, generated panels."""
