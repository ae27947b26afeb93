"""Operators of a training-data pipeline over text, conversation, page and embedding tables."""
