"""Readers, log tables, reports and the model registry."""
