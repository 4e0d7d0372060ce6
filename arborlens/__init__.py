"""A Spark-native engine for property graphs of source code."""
