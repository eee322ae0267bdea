"""Payment reconciliation as Spark jobs."""
