"""Structured Streaming over observation frames."""
