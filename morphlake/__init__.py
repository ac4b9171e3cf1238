"""A Spark-native engine for declarative record transformation."""
