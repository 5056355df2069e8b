"""Spark-native analytics for recorded multi-channel time series and telemetry."""
