"""Document processing and hybrid retrieval as Spark DataFrame plans."""
