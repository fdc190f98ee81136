"""Exports and deterministic sinks."""
