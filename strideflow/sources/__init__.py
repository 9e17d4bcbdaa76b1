"""Readers and writers for the documents and tables of the project."""
