"""pulse: analytics over short public posts and request logs, as Spark jobs."""
