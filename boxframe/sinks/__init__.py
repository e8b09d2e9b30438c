"""boxframe.sinks."""
