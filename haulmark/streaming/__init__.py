"""Structured Streaming over the feed of extracted quote requests."""
