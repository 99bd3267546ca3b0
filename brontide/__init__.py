"""brontide: time-series, metric and event analytics as DataFrame plans."""
