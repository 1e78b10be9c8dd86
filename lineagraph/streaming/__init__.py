"""streaming of the provenance engine."""
