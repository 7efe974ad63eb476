"""A PySpark-native engine for analytics over document collections."""
