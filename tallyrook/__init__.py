"""Document-intake analytics on Spark: extraction, critics, routing, evaluation and ledgers as DataFrame plans."""
