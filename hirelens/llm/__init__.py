"""Operators for preparing language-model training data.

Nothing outside this package imports it. ``hirelens.llm.queries`` registers one query
per operator; ``corpus_pipeline.py`` chains five of them.
"""
