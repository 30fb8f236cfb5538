"""Corpus embedding and semantic-drift analytics as Spark DataFrame jobs."""
