"""Column-level building blocks (no shuffles, no Python on the data path)."""
