"""Data sources, sinks and containers."""
