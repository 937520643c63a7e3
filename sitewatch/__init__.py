"""Clinical trial operations analytics as Spark jobs."""
