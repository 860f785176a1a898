"""Structured Streaming forms of the review jobs."""
