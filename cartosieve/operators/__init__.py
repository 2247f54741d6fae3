"""operators of the layer quality engine."""
