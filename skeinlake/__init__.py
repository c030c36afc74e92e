"""Spark-native corpus curation, hybrid retrieval and learner analytics."""
