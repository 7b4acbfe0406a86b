"""A PySpark-native analytics engine for scientific source documents."""
