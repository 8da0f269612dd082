"""Operators over pixels, frames and blocks."""
