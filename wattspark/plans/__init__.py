"""Plans of the load-series engine."""
