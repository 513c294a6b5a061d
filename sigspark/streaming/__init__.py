"""Structured Streaming forms of a few operators; extensions, not part of the inventory."""
