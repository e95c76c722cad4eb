"""Incremental loads."""

from rollbook.streaming.ingest import ingest_dir

__all__ = ["ingest_dir"]
