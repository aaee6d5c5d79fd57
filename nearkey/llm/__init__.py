"""Training-data operators: one module each, joined by :mod:`nearkey.llm.registry`."""
