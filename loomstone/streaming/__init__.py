"""Stateful operators on streams of bytes: rows (stream_id, offset, data)."""
