"""Source-code statistics and corpus operators on Spark."""

__version__ = "0.1.0"
