"""App-store payload analytics on Spark."""
