"""Spark-native numeric-array compression research and corpus curation."""
