"""Analytics of documents and their syntax on Spark."""
