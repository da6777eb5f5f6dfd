"""Bytes to values and back; plain Python, for use in Arrow batches."""
