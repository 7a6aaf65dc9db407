"""paceframe: fitness and running telemetry analytics as Spark DataFrame operators."""
