"""Incremental forms of the journal operators."""
