"""functions of the versioned store."""
