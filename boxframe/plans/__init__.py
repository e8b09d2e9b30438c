"""boxframe.plans."""
