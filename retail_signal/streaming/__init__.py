"""Structured Streaming: incremental landing (J1), store-day totals kept up
to date (J2) and an online decline alert per store (J3)."""
