"""Readers and writers of extracts."""
