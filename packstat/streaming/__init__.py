"""Structured Streaming monitors over run telemetry."""
