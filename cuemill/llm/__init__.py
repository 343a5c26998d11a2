"""Preparing transcripts and related texts as training data."""
