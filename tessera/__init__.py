"""A PySpark-native engine for explainable category scoring and validation."""
