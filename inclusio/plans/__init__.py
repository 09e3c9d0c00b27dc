"""The query catalogue: Spark builders and their oracle SQL."""
