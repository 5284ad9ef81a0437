"""Evidence retrieval, grounding and evaluation expressed as Spark DataFrames."""

__version__ = "0.1.0"
