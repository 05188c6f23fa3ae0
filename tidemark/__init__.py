"""Tidemark: point-in-time analytics over dated text and time series, written as Spark DataFrame jobs."""
