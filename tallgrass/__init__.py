"""Tallgrass: indexing, hybrid retrieval and retrieval-log analytics on PySpark DataFrames."""

__version__ = "0.1.0"
