"""Spark-native curation of conversational corpora and analysis of paired benchmark outputs."""

__version__ = "0.1.0"
