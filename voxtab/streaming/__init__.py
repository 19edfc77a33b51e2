"""Streams over job events and submissions."""
