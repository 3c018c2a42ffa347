"""Readers: archives, single-message files, pattern and prompt files."""
