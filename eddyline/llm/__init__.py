"""Operators for training text and for summaries of very large columns."""
