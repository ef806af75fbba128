"""Steel mill certificate analytics as Spark DataFrame jobs."""
