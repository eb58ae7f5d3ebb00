"""sources of the versioned store."""
