"""Analytics on large numeric tables and 3-D volumes as Spark DataFrame transformations."""
