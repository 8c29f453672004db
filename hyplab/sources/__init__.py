"""Readers and writers with table contracts."""
