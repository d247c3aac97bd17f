"""Similarity, change and anomaly operators on Spark."""
