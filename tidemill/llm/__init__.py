"""Operators of a training-corpus pipeline. Nothing outside this package imports it."""
