"""Incremental ingestion and stateful conversations with Structured Streaming."""
