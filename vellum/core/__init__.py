"""PDF parsing and interpretation in plain Python, without Spark: what runs inside the workers."""
