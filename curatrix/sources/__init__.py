"""Readers, writers and file-level reports."""
