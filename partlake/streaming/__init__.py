"""Structured Streaming: landing folders as streams, windows with late data, deduplication, change memory."""
