"""Timed-text quality control and corpus analysis as Spark jobs."""
