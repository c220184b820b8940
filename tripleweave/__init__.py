"""A virtual knowledge graph engine on Spark."""
