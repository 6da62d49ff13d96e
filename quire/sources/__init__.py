"""Readers and writers: JSON lines with rejects, line index, named splits."""
