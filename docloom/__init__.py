"""Evidence retrieval and document analytics as Spark jobs."""
