"""Operators over the graph tables; each takes and returns DataFrames."""
