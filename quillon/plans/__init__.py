"""plans of quillon."""
