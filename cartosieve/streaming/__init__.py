"""streaming of the layer quality engine."""
