"""bookweave: market-event analytics written as Spark DataFrame jobs."""
