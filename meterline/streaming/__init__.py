"""Structured Streaming versions of ingest and of the minute KPIs."""
