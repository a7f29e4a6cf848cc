"""A PySpark-native engine for multi-step questions over country x indicator x year series."""
