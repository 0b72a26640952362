"""Screening funnels on Spark: narrow a very large candidate table step by step,
keeping the reason of every rejection, down to a short ranked list."""

__version__ = "0.1.0"
