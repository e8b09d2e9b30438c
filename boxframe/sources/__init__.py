"""boxframe.sources."""
