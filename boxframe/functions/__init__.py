"""boxframe.functions."""
