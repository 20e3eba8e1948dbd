"""Shot retrieval, claim checking and sequence planning on Spark DataFrames."""
__version__ = "0.1.0"
