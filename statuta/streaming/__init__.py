"""Structured Streaming: event windows and incremental indexes."""
