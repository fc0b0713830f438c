"""Document and engagement analytics expressed as Spark jobs."""
