"""functions of the layer quality engine."""
