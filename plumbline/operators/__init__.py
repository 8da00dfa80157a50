"""Validation, profiling, scoring and repair as DataFrame operators."""
