"""plans of the layout engine."""
