"""functions of quillon."""
