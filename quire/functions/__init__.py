"""functions layer of the document layout engine."""
