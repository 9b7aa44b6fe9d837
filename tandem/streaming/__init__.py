"""Structured Streaming jobs over log files."""
