"""almanack: a Spark-first engine for documented statistical datasets."""

__version__ = "0.1.0"
