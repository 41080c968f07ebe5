"""Structured Streaming, beyond parity: the reference has no streams."""
