"""strandweave: similarity mapping of sequences and texts as Spark DataFrame plans."""
