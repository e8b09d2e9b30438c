"""boxframe.streaming."""
