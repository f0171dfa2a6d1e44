"""Structured Streaming forms of rate limits, history, retention and ingestion."""
