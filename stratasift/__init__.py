"""A Spark-native engine for retrieval and knowledge analytics over document collections."""
