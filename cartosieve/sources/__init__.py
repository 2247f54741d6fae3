"""sources of the layer quality engine."""
