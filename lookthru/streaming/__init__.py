"""Structured Streaming jobs over the tick feed."""
