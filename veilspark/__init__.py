"""Spark-native detection, review and redaction of personal identifiers in document text."""
