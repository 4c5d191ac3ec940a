"""Cross-border trade analytics as Spark DataFrame operators."""
