"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing else in the library imports this subpackage; its queries are
registered from ``hazardflow.llm.queries``.
"""
