"""A PySpark engine for ordered, timestamped text."""
