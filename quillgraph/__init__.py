"""A PySpark engine for typed document graphs."""
