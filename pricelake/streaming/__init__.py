"""Continuous ingestion of a landing directory."""
