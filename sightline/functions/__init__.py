"""Column functions and the few Arrow helpers that Spark has no builtin for."""
