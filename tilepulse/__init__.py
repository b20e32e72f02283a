"""Device-lifecycle and map-tile analytics as plain Spark DataFrame jobs."""
