"""A document-analytics engine expressed as Spark plans."""
