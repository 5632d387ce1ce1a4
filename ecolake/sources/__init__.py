"""Readers. Each takes a DataFrame of files (``path``, ``text``) or lists one from a folder."""
