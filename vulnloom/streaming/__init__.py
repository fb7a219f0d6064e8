"""Structured Streaming jobs: incremental advisory merge and windowed counts."""
