"""Evidence-view analytics on Spark."""
