"""PySpark-native processing of nested page-and-region collections."""
