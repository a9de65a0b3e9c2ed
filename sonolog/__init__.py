"""Listening-history enrichment and analytics as plain Spark DataFrame jobs."""
