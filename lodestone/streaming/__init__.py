"""Structured Streaming extensions: incremental ingest and event rollups."""
