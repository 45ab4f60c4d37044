"""Rule matching, reporting, diffing and policy evaluation as Spark jobs."""

__version__ = "0.1.0"
