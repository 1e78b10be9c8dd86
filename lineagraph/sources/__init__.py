"""sources of the provenance engine."""
