"""Risk analytics over code, text and software supply chains, on Spark DataFrames."""

__version__ = "0.3.0"
