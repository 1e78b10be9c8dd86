"""functions of the provenance engine."""
