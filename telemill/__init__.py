"""Machine-telemetry anomaly analytics as Spark jobs."""
