"""Sliding windows over streams of frames."""
