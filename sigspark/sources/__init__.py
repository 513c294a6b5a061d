"""Readers and writers of recordings, annotations and results."""
