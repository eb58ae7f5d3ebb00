"""streaming of the versioned store."""
