"""Document reconciliation as Spark DataFrame and Structured Streaming jobs."""
