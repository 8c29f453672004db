"""Incremental processing of hypothesis tables."""
