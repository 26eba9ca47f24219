"""Relational operators over e-mail tables."""
