"""Structured Streaming jobs, each with a batch twin."""
