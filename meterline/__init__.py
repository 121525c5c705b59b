"""Spark analytics over data-warehouse query telemetry."""
