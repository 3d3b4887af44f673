"""Associative memory analytics as DataFrame transforms."""
