"""Streams: the batch rules on rows as they arrive."""
