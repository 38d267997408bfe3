"""Redirect mapping for broken URLs as Spark DataFrame jobs."""
