"""A PySpark-native document-processing and analytics engine."""
