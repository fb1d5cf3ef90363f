"""logstrata: analytics over versioned key-value logs, as Spark DataFrame operators."""
