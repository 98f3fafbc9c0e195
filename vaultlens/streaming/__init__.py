"""Structured Streaming twins of the tracking and job operators."""
