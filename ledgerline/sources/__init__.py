"""Readers and sheet layouts."""
