"""Sources of the load-series engine."""
