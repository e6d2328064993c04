"""Typed property graphs and corpora as DataFrames: index, query, maintain."""
