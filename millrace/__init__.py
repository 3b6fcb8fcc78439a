"""A PySpark-native relational engine."""
