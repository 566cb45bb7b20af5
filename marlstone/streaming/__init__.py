"""Incremental analysis on Structured Streaming."""
