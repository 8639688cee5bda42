"""Structured Streaming jobs with the same results as their batch twins."""
