"""Relational and time-series operators; each takes and returns DataFrames."""
