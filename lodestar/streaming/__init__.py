"""Structured Streaming counterparts of the epoch log."""
