"""placelens: location analytics as PySpark DataFrame jobs."""
