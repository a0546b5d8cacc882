"""Panel and time-series analytics as plain DataFrame functions on Spark."""

__all__ = ["session", "scratch"]
