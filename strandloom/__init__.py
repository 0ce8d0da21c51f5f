"""strandloom: clustering of noisy short strings as Spark DataFrame jobs."""
