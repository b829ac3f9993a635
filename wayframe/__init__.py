"""A Spark-native engine for navigation text and street graphs."""
