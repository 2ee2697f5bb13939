"""Structured Streaming twins of batch plans."""
