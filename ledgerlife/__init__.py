"""Customer-lifecycle analytics over a trade log, as Spark DataFrame functions."""

__all__ = ["functions", "operators", "plans", "sources"]
