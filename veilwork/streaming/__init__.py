"""Structured Streaming: the vault, restoring chunked bodies, and late or repeated reports."""
