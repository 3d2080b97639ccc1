"""Feature profiling, preprocessing, forest scoring and load-test analytics on Spark."""

__version__ = "0.1.0"
