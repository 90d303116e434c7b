"""Readers, writers and row parsers."""
