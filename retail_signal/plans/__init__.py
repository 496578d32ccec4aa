"""Composed plans: the end-to-end feature job and the registry of named
queries (each with an equivalent SQL text for an independent engine)."""
