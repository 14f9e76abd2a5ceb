"""Stateless vector operators over Structured Streaming sources."""
