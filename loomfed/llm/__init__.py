"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; its queries and SQL are in
:mod:`loomfed.llm.queries`.
"""
