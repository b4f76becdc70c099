"""rulelens: rule-table text analytics as Spark jobs."""
