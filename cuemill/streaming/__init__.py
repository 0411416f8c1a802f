"""Structured Streaming: log lines without repeats, and answers gathered from deltas."""
