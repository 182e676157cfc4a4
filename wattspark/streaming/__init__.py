"""Streaming of the load-series engine."""
