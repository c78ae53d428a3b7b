"""tidepanel: panel and time-series analytics as Spark DataFrame transformations."""
