"""A PySpark-native engine for context search, ingestion and log analytics."""
