"""Readers and writers: typed scans, path-derived columns, digests and sinks."""
