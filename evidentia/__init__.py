"""Evidence analytics on Spark: document queries, governed metrics, retrieval, corpus and trace operators."""
