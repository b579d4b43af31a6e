"""Profiling, validation, preparation, training, evaluation and monitoring."""
