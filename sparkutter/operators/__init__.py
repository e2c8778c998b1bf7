"""Relational operators over token tables."""
