"""Indoor-capture analytics as Spark DataFrame jobs."""
