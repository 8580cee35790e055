"""A PySpark-native retrieval and retrieval-analytics engine."""
