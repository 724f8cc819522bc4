"""Deductive analytics on Spark: Horn-rule programs, provenance, inference and ranking as DataFrame jobs."""
