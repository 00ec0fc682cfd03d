"""Lodestone: retrieval, similarity graphs and conversation-log analytics on Spark DataFrames."""

__version__ = "0.1.0"
