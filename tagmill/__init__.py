"""PySpark-native label analytics."""
