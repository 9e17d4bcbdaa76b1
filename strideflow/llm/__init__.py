"""Training-data operators over text, page, vector and conversation tables."""
