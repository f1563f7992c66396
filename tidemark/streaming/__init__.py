"""Structured Streaming: bars, sessions, deduplication, merging sinks and state with a time to live."""
