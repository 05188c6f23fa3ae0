"""Structured Streaming versions of the batch aggregates."""
