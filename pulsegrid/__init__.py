"""pulsegrid: fleet-telemetry anomaly and reliability analytics as Spark jobs."""
