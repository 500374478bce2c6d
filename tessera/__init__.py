"""Tessera: retrieval analytics and data preparation as Spark DataFrame plans."""

__version__ = "0.1.0"
