"""Spark-native lexical retrieval and text-collection processing."""
