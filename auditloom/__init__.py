"""Host audit telemetry analytics as Spark DataFrame operators."""
