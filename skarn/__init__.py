"""Retrieval and fact analytics on Spark."""
