"""Operators of the load-series engine."""
