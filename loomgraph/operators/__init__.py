"""Operators over graphs: every one takes and returns DataFrames."""
