"""Structured Streaming jobs over the event ledger."""
