"""Structured Streaming: change feeds, debounce, incremental sync."""
