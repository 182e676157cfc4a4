"""Functions of the load-series engine."""
