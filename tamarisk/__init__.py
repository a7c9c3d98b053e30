"""Spark-native audit analytics over documents, cues, annotations and scores."""
