"""Log-sequence anomaly analytics as Spark DataFrame operators."""
