"""Evidence analytics as Spark DataFrame operators."""
