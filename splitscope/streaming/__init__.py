"""Incremental landing of session files (Structured Streaming).

The published workflow analyses a finished experiment in batch; it has no
streaming analytics. This module only keeps the raw session table current:
new session files are appended exactly once (checkpointed), and the batch
operators then run on the table.
"""

from splitscope.streaming.ingest import land_sessions

__all__ = ["land_sessions"]
