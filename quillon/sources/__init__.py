"""sources of quillon."""
