"""Structured Streaming form of corpus ingestion (the counts of A1 / C2 kept up to date)."""
