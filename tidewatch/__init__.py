"""Tidewatch: a PySpark-native engine for document-watch analytics."""
