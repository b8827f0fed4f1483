"""Literature-corpus analytics as Spark DataFrame operators."""
