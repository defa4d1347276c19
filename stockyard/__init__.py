"""Limited-stock commerce analytics as Spark DataFrame transforms."""
