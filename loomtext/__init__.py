"""Spark-first analytics for media catalogues, timed transcripts, pages and text corpora."""
