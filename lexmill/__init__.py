"""lexmill: Boolean text retrieval and index analytics as plain Spark plans."""
