"""Readers and writers: traces, message streams, stored tables."""
