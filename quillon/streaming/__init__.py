"""streaming of quillon."""
