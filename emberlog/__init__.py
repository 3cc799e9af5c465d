"""emberlog: log and event forensics on PySpark DataFrames."""

__version__ = "0.1.0"
