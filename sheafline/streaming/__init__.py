"""Recomputation when files change."""
