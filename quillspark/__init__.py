"""A Spark-native engine for document retrieval analytics."""
