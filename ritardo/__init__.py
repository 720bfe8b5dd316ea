"""Note-event analytics expressed as Spark DataFrame jobs."""
