"""PySpark-native analytics for inference-workload telemetry."""
