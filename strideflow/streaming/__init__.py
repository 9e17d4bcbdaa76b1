"""Structured Streaming counterparts of the ordered operators."""
