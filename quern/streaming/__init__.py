"""Continuous forms of the telemetry, on Structured Streaming."""
