"""Readers, file checks and writers."""
