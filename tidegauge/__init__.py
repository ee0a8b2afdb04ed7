"""Stream-quality analytics as Spark jobs."""
