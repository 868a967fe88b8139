"""Security-event analytics as Spark DataFrame jobs."""
