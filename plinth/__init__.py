"""A Spark-native engine for grounding analytics."""
