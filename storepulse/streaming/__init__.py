"""Structured Streaming readers, stateful operators and idempotent sinks."""
