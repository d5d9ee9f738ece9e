"""Flows composed from the operators."""
