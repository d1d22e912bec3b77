"""Operators for training corpora.

Nothing else in the library imports this subpackage; it can be deleted as a
whole together with ``corpus_pipeline.py`` and ``tests/llm``.
"""
