"""Structured Streaming twins of the stateful operators (ST1-ST8)."""
