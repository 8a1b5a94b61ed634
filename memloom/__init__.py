"""memloom: a PySpark-native engine for conversational-memory data and training-data preparation."""

__version__ = "0.1.0"
