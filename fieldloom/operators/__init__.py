"""Relational operators with strict failure rules."""
