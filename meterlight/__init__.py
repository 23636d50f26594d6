"""Spark-native analytics over coding-agent token usage."""
