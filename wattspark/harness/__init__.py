"""Harness of the load-series engine."""
