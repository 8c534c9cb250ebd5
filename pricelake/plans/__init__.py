"""End-to-end plans: ingesting files and answering queries over the tables."""
