"""Open-set retrieval analytics over embedding tables, written as Spark jobs."""
