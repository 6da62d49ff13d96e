"""Structured Streaming forms of the stateless corpus stages and running reports."""
