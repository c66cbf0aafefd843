"""Readers and writers of semi-structured files."""
