"""plans of the versioned store."""
