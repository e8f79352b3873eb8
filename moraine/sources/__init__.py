"""Sources and sinks beside Spark's own."""
