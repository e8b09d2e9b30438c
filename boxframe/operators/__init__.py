"""boxframe.operators."""
