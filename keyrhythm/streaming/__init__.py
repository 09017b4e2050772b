"""Structured Streaming jobs built on the same expressions as the batch jobs."""
