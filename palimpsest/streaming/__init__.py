"""Structured Streaming and incremental stores."""
