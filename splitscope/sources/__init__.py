"""Readers and writers: session tables, user-level CSV, result sinks."""
