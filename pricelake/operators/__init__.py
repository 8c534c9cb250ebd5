"""DataFrame-level operators shared by the ingest and serving plans."""
