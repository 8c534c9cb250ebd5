"""Readers: file manifest, head sniffing, CSV, JSON and NDJSON scans."""
