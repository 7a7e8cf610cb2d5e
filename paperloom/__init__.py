"""A Spark-native engine for document retrieval pipelines and their training data."""
