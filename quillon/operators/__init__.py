"""operators of quillon."""
