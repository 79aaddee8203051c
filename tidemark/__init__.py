"""tidemark: a Spark engine for signed, versioned discovery indexes."""
