"""streaming of the layout engine."""
