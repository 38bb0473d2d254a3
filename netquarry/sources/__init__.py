"""Readers of logs and stored tables, and their sinks."""
