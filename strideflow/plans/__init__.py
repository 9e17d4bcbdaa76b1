"""Carrier views over the provided tables, and one registered query per operator."""
