"""Document retrieval, evidence tracing and training-data preparation as Spark DataFrame operators."""
