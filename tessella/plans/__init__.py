"""Whole plans put together from operators, and what they share."""
