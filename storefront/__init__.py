"""Business-directory extraction over captured pages, on Spark."""
