"""Sinks: partitioned panel tables and CSV, JSON and Parquet exports."""
