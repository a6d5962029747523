"""hopweave: multi-hop graph retrieval and evaluation as Spark plans."""
