"""Whole jobs: recognition, selection, batch processing."""
