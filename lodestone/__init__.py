"""A retrieval analytics engine expressed as Spark DataFrame and SQL transformations."""
