"""Schema-corpus analytics on Spark."""
