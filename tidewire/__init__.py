"""Tidewire: network-flow analytics on PySpark DataFrames and Structured Streaming."""

__version__ = "0.1.0"
