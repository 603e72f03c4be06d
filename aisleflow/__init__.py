"""Spark-first store analytics: events, zones, identities, tracking, evaluation and streams."""
