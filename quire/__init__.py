"""Document-structure analytics on Spark: documents in as rows, typed structure and answers about it out as tables."""
