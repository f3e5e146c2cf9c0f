"""docspark: Spark jobs for document libraries."""
