"""A PySpark-native analytics engine for web-site search performance."""
