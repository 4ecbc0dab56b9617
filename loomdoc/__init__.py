"""loomdoc: document-intelligence and retrieval analytics as Spark DataFrame operators."""
