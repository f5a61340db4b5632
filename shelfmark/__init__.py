"""Product-listing analytics as Spark DataFrame jobs."""
