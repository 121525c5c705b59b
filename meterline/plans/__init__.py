"""Operators composed into table refreshes and named queries."""
