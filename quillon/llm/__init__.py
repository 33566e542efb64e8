"""Training-data operators; nothing else in quillon imports this package."""
