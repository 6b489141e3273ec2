"""Operators for building training data for language models.

Each numbered module holds one operator with a general interface, and the thin query over the
test tables that is registered in :mod:`tidewright.llm.registry`.
"""
