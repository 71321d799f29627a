"""A Spark-native engine for usage, event and training-data analytics."""
