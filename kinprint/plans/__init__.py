"""Whole query plans put together from the operators."""
