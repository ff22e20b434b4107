"""statuta: regulation and document analytics as Spark DataFrame jobs."""
