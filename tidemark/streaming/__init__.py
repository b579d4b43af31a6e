"""Streaming monitoring of scored rows."""
