"""Spark-native sensor refinement, correspondence analytics and training-data operations."""
