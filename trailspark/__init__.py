"""Spark-native analytics over the activity trails of AI coding agents."""
