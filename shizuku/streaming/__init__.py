"""Structured Streaming forms of the daily roll-up."""
