"""Sightline: multi-camera trajectory evidence as Spark DataFrame, SQL and Structured Streaming jobs."""
