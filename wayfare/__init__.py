"""Next-visit analytics as Spark jobs."""
