"""Structured Streaming jobs. They reuse the batch operators."""
