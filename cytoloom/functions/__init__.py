"""Column expressions, canonical JSON and digests."""
