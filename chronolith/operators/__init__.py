"""operators of the versioned store."""
