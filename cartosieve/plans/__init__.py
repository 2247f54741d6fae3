"""plans of the layer quality engine."""
