"""Investigation analytics on Spark."""
