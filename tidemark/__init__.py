"""tidemark: user-level analytics operators over Spark DataFrames and streams."""

__version__ = "0.1.0"
