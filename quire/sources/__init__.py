"""Readers of document files."""
