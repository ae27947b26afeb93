"""Codecs composed from operators."""
