"""Operators for training-data pipelines over large document tables.

Nothing else in the library imports this subpackage; its queries are in
:mod:`loomgraph.llm.queries`.
"""
