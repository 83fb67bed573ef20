"""proofmill: evidence, provenance and evaluation analytics on Spark."""
