"""fieldloom: validated, reusable data products on Spark DataFrames."""

__version__ = "0.1.0"
