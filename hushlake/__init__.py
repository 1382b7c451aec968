"""PySpark-native privacy analytics engine."""
