"""Spark-native spend analytics for LLM API usage."""
